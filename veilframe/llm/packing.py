"""Best-fit packing of tokenised documents into sequences of bounded length, by linear grouping.

The texts are tokenised once; a table of pieces (ids, lengths, checksums) is written to the shared folder. Packing
needs only how many pieces there are of each length, at most `capacity` numbers, so the plan is made on the driver from
a table whose size does not depend on the corpus:

1. large lengths are sorted into 128 groups of equal cardinality and rounded up to the longest of their group (a piece
   that fills a sequence by itself is one);
2. the configurations of those few sizes that need the fewest sequences are found by column generation, and each is used
   as often as that says, to the nearest whole number;
3. real lengths take the places of the rounded ones, the last of a configuration as long as the room allows. Pieces whose
   places others have filled are grouped anew, into half as many; the last of them get sequences of their own, as full as can be;
4. small pieces go, longest first, where they fit best.

The plan says for each length which ranks go to which sequences; pieces get their rank within their length from a
two-level count, so that a length which holds a third of all pieces is ranked in many tasks.

Defined cases: null text is empty and gives one piece, the separator; repeated rows are packed each; null ids are kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import bpe
from veilframe.llm.shared import chunks, documents, materialize, named

CAPACITY = 2048
#: Sizes that large lengths are rounded up to, at most; shorter lengths than SMALL are not rounded.
GROUPS, SMALL = 128, 128
#: Groupings: of all, then of what was left over, each time into half as many groups.
ROUNDS = 2
SEPARATOR = 0
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    plain = df.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("_text"))

    def cut(batches):
        encode = bpe.load(tokenizer_path).ids
        for batch in batches:
            for part in chunks(batch, "_text"):
                at, out = [], [[], [], [], []]
                for row, text in enumerate(part.column("_text")):
                    ids = np.array([*encode(text.as_py()), SEPARATOR], dtype="<u4")
                    starts = cuts(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        at.append(row)
                        for column, value in zip(out, (k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return plain.mapInArrow(cut, T.StructType([plain.schema["doc_id"], *T.StructType.fromDDL(PIECE)]))


def grouped(large: dict[int, int], groups: int) -> dict[int, int]:
    """Counts of the rounded sizes: the lengths in order, cut into groups of equal cardinality, each rounded up to its longest."""
    total, taken, rounded, group, size = sum(large.values()), 0, {}, -1, 0
    for n, c in sorted(large.items(), reverse=True):
        while c:
            if (g := taken * groups // total) != group:
                group, size = g, n  # the first length of a group is its longest
            part = min(c, max(1, -(-(g + 1) * total // groups) - taken))
            rounded[size] = rounded.get(size, 0) + part
            taken, c = taken + part, c - part
    return rounded


def fullest_by(gain: np.ndarray, sizes: np.ndarray, copies: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the gains sum to the most within capacity: a knapsack, copies in powers of two."""
    best, steps = np.zeros(capacity + 1), []
    for i in np.flatnonzero(gain > 1e-12).tolist():
        left, part = int(copies[i]), 1
        while left:
            k = min(part, left)
            left, part, width = left - k, 2 * part, k * int(sizes[i])
            if width > capacity:
                break
            taken = best[:-width] + k * gain[i]
            better = taken > best[width:]
            best[width:][better] = taken[better]
            steps.append((i, k, width, better))
    out, at = np.zeros(len(sizes)), capacity
    for i, k, width, better in reversed(steps):
        if at >= width and better[at - width]:
            out[i] += k
            at -= width
    return out


def configurations(rounded: dict[int, int], capacity: int, rounds: int = 1000) -> list[tuple[float, list[int]]]:
    """(how often, sizes) of the configurations that pack the rounded sizes into the fewest sequences, fractions allowed.

    Column generation: a basis of configurations, one more at a time where the knapsack over the sizes' prices finds one
    worth more than a sequence; it ends when no packing can be better by more than 1 in 1,000. `rounds` bounds the
    time on the driver, not what is packed.
    """
    sizes = np.array(sorted(rounded, reverse=True), dtype=np.int64)
    need = np.array([rounded[n] for n in sizes.tolist()], dtype=float)
    copies = np.minimum(need, capacity // sizes)
    inverse, columns, often = np.diag(1 / copies), [c * e for c, e in zip(copies, np.eye(len(sizes)), strict=True)], need / copies
    for _ in range(rounds if len(sizes) else 0):
        prices = inverse.sum(axis=0)
        column = fullest_by(prices, sizes, copies, capacity)
        worth, total = prices @ column, often.sum()
        if worth <= 1 + 1e-9 or total - total / worth < max(0.3, 1e-3 * total):  # total / worth bounds every packing from below
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-10, np.maximum(often, 0) / np.where(direction > 1e-10, direction, 1), np.inf)
        leaves = int(ratio.argmin())
        step = ratio[leaves]
        often = often - step * direction
        often[leaves], columns[leaves] = step, column
        inverse[leaves] /= direction[leaves]
        direction[leaves] = 0
        inverse -= np.outer(direction, inverse[leaves])
    found = [(float(x), [n for n, k in zip(sizes.tolist(), c.tolist(), strict=True) for _ in range(int(k))]) for x, c in zip(often, columns, strict=True)]
    return sorted(found, key=lambda f: -f[0])


class Plan:
    """Classes of equal sequences: (how many, [(length, copies), ...])."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = GROUPS, small: int = SMALL):
        self.capacity = capacity
        self.done: list[tuple[int, list[tuple[int, int]]]] = []
        self.open: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
        self.left = {n: c for n, c in counts.items() if c}
        if full := self.left.pop(capacity, 0):
            self._add(full, [(capacity, 1)])
        self.rounded: list[dict[int, int]] = []
        self.substituted = 0  # pieces that took the place of a rounded size
        for turn in range(ROUNDS):
            self._grouping(max(1, groups >> turn), small)
        self._rest({n: c for n, c in self.left.items() if n >= small})
        for n, c in sorted(((n, c) for n, c in counts.items() if n < small), reverse=True):
            self._best_fit(n, c)
        self.classes = self.done + [x for found in self.open.values() for x in found]
        self.sequences = sum(m for m, _ in self.classes)

    def _grouping(self, groups: int, small: int) -> None:
        """Large pieces that are left: rounded in groups, configured, and put in the places of their rounded sizes."""
        large = {n: c for n, c in self.left.items() if n >= small}
        rounded = grouped(large, groups)
        self.rounded.append(rounded)
        self.least = dict(zip(sorted(rounded), [small, *sorted(rounded)], strict=False))  # of each group the least length it can have
        self.lengths = sum(1 << n for n in large)  # bit n: some piece of length n is left
        for often, sizes in configurations(rounded, self.capacity):
            self._substitute(int(often + 0.5), sizes)
        self.substituted += sum(large.values()) - sum(self.left.get(n, 0) for n in large)

    def _add(self, size: int, items: list[tuple[int, int]]) -> None:
        room = self.capacity - sum(n * k for n, k in items)
        (self.open[room] if room else self.done).append((size, items))

    def _substitute(self, times: int, sizes: list[int]) -> None:
        """Real lengths in a configuration's places: each takes the longest left that its rounded size admits, the last the longest that the room does.

        Where a place finds only pieces of groups below its own, the configuration has served its time: last places took what it would hold.
        """
        while times:
            taken: Counter = Counter()
            room, lengths = self.capacity, self.lengths
            for i, size in enumerate(sizes):
                most = room if i == len(sizes) - 1 else size
                n = (lengths & ((1 << (most + 1)) - 1)).bit_length() - 1
                if n < self.least[size]:
                    return
                taken[n] += 1
                room -= n
                if taken[n] == self.left[n]:
                    lengths &= ~(1 << n)
            part = min(times, *(self.left[n] // k for n, k in taken.items()))
            self._take(part, taken)
            times -= part

    def _take(self, times: int, items: Counter) -> None:
        for n, k in items.items():
            self.left[n] -= k * times
            if not self.left[n]:
                del self.left[n]
                self.lengths &= ~(1 << n)
        self._add(times, sorted(items.items(), reverse=True))

    def _rest(self, left: dict[int, int]) -> None:
        """Large pieces that rounding left over: each with the fullest company, from the longest."""
        while left:
            items = self._fullest(max(left), left)
            times = min(left[n] // k for n, k in items.items())
            self._take(times, items)
            left = {n: self.left[n] for n in left if n in self.left}

    def _fullest(self, top: int, left: dict[int, int]) -> Counter:
        """The fullest set of sizes that holds top: subset sums as bits of an integer, large sizes preferred."""
        room, mask = self.capacity - top, (1 << (self.capacity - top + 1)) - 1
        sizes = [(n, min((c - (n == top)), room // n)) for n, c in sorted(left.items()) if n <= room]
        reach, steps = 1, []
        for n, c in sizes:
            steps.append((n, c, reach))
            part = 1
            while c > 0:
                part = min(part, c)
                reach |= reach << (n * part) & mask
                c, part = c - part, part * 2
        total, items = reach.bit_length() - 1, Counter({top: 1})
        for n, c, before in reversed(steps):
            k = next(k for k in range(min(c, total // n), -1, -1) if before >> (total - k * n) & 1)
            if k:
                items[n] += k
                total -= k * n
        return items

    def _best_fit(self, n: int, count: int) -> None:
        while count:
            room = min((r for r, found in self.open.items() if r >= n and found), default=None)
            if room is None:
                fits = self.capacity // n
                for many, k in ((count // fits, fits), (1, count % fits)):
                    if many and k:
                        self._add(many, [(n, k)])
                return
            size, items = self.open[room].pop()
            fits = room // n
            full = min(size, count // fits)
            if full:
                self._add(full, [*items, (n, fits)])
                count, size = count - full * fits, size - full
            if size and count and count < fits:
                self._add(1, [*items, (n, count)])
                count, size = 0, size - 1
            if size:
                self.open[room].append((size, items))

    def slots(self) -> dict[int, np.ndarray]:
        """For each length rows of (first rank, first sequence, copies, offset), by first rank."""
        rows: dict[int, list] = defaultdict(list)
        rank: dict[int, int] = defaultdict(int)
        base = 0
        for size, items in self.classes:
            offset = 0
            for n, k in items:
                rows[n].append((rank[n], base, k, offset))
                rank[n] += size * k
                offset += n * k
            base += size
        return {n: np.array(x, dtype=np.int64) for n, x in rows.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, rows_a_bucket: int = 20_000) -> DataFrame:
    """The pieces with sequence_id and offset. cut must be a stored table."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = Plan(counts, capacity, GROUPS, min(SMALL, capacity // 8 + 1)).slots()
    buckets = max(64, -(-sum(counts.values()) // rows_a_bucket))
    dealt = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = dealt.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = before.select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_before")).select(*cut.columns, "_r")
    shipped = cut.sparkSession.sparkContext.broadcast(slots)  # bounded by the number of lengths and classes, not by the corpus

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_r"))
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                table = shipped.value[n]
                row = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
                j = ranks[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + j // row[:, 2], row[:, 3] + j % row[:, 2] * n
            kept = batch.select([c for c in batch.schema.names if c != "_r"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return ranked.mapInArrow(place, T.StructType([*cut.schema, *T.StructType.fromDDL("sequence_id bigint, offset bigint")]))


def best_fit_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(df, id_col, text_col, capacity, tokenizer_path), "pieces"), capacity)


def op7(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))

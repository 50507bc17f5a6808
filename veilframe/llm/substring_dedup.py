"""Substring deduplication by recompression.

Words are names. A round of recompression first collapses runs: a maximal run of one name becomes a symbol named by that
name and its length. Then pairs: every symbol is a left or a right one, by a bit of its name, and a left one followed by
a right one becomes a symbol named by both. Names are hashes of what they stand for, so all executors name alike, without
a table of names. What becomes of a symbol depends on its neighbours alone, so two copies of a substring have equal
interior symbols: where no word stands twice in a row, r rounds cost at most 2**r words at either end. (Later rounds
collapse no runs; equal symbols never pair, and so stay as they are.)

A phrase is the shortest stretch of whole symbols of at least `phrase` words, named by their names. Of each `thin`
phrases that follow each other the one with the least name is an anchor; `thin` is what a window's interior holds at the
least, so every copy of a window has an anchor inside, and it is the same one. In a window with a word twice in a row a
run may reach beyond its ends; such a window is an anchor itself.

1. Anchors: each group of documents sends its distinct anchors; those found in two documents come back.
2. Windows: the names of windows that contain a shared anchor are sent with the least document that has them. Of the groups
   that have a window, that with the smallest document is asked for its words on behalf of the others.
3. Words: it sends them, as stretches of words that cover what was asked for, with the id of their document.
4. A window goes if its words, one by one, are those of a window of a smaller document, received or of its own group.
   Names only find windows; no word is removed for a hash alone.

Documents are dealt into groups of a bounded number of bytes once, and that exchange is reused; what travels between the
groups is at most one entry a group for any anchor or window, however many documents share it, as sorted, packed columns,
and at most one copy a group of any repeated passage. Names have 64 bits. Should two different windows of two groups have
one name, a repeat may be missed; n windows have n^2 / 2^65 such pairs. Within a group none is missed.

Defined cases: a null text has no words; a null id counts as larger than any id (2^63 - 1 counts like null); documents of
the same id never remove from each other, so repeated rows get equal results; a text shorter than a window keeps all; an
empty table is empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.shared import documents, named

WINDOW, ROUNDS, PHRASE = 13, 1, 5
GROUP_BYTES, BUCKET_BYTES, TASK_BYTES = 8 << 20, 96 << 20, 64 << 20
M = 0x9E3779B97F4A7C13
INVERSE = pow(M, -1, 1 << 64)
NO_ID = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII white space, and a random number for each byte.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
#: Bytes named at a time; longer words are hashed one by one.
_BLOCK, _LONG_WORD = 1 << 20, 64


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i up to n."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)])) for m in (M, INVERSE))


def names(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of the texts, and how many words each has.

    A word's name is a polynomial over its bytes, from running sums over a block; a long word's is its XXH64, since words
    of many bytes can be made whose polynomials modulo 2**64 agree.
    """
    buffer = b" ".join([t or b"" for t in texts])
    bytes_ = np.frombuffer(buffer, dtype=np.uint8)
    word = np.concatenate([[False], ~_SPACE[bytes_], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum([len(t or b"") + 1 for t in texts])
    sizes = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    out = np.empty(len(starts), dtype=np.uint64)
    power, undo = _powers(_BLOCK + _LONG_WORD)
    long = ends - starts > _LONG_WORD
    for i in np.flatnonzero(long).tolist():
        import xxhash

        out[i] = xxhash.xxh64_intdigest(buffer[starts[i]:ends[i]])
    short = np.flatnonzero(~long)
    cuts = np.searchsorted(starts[short], np.arange(0, len(bytes_) + _BLOCK, _BLOCK))
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if lo < hi:
            at = short[lo:hi]
            first, last = int(starts[at[0]]), int(ends[at[-1]])
            sums = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum(_BYTE[bytes_[first:last]] * power[:last - first], out=sums[1:])
            s, e = starts[at] - first, ends[at] - first
            out[at] = mixed((sums[e] - sums[s]) * undo[s] + (e - s).astype(np.uint64))
    return out, sizes


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of what two names stand for, one after the other."""
    return mixed((left ^ (left >> np.uint64(29))) * np.uint64(M) + (right ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93))


class Group:
    """The words of a group of documents as one sequence of names."""

    def __init__(self, texts: list[bytes | None], ids: list[int | None]):
        self.x, self.sizes = names(texts)
        self.ends = np.cumsum(self.sizes)
        self.ids = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)

    def named(self, window: int) -> np.ndarray:
        """Names of the windows of so many words from every start: of 1, 2, 4, ... words, put together."""
        power, width, out, done = self.x, 1, None, 0
        n = len(self.x) - window + 1
        while True:
            if window & width:
                out = power[:n] if out is None else joined(out, power[done:done + n])
                done += width
            if 2 * width > window:
                return out
            power, width = joined(power[:-width], power[width:]), 2 * width

    def symbols(self, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, starts and ends (in words) of the symbols after so many rounds."""
        n = len(self.x)
        new = np.ones(n, dtype=bool)
        new[1:] = (self.x[1:] != self.x[:-1]) | (self.doc[1:] != self.doc[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], n)
        x = np.where(b - a > 1, joined(self.x[a], (b - a).astype(np.uint64)), self.x[a])
        for r in range(rounds):
            if len(x) < 2:
                break
            right = mixed(x + np.uint64(r)) >> np.uint64(63) == 1
            head = np.flatnonzero(~right[:-1] & right[1:] & (self.doc[a[:-1]] == self.doc[a[1:]]))
            x, b = x.copy(), b.copy()
            x[head] = joined(x[head], x[head + 1])
            b[head] = b[head + 1]
            keep = np.ones(len(x), dtype=bool)
            keep[head + 1] = False
            x, a, b = x[keep], a[keep], b[keep]
        return x, a, b

    def anchors(self, window: int, rounds: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, starts and ends of the anchors of documents that have a window: phrases, and windows with a word twice in a row."""
        if len(self.x) < window:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, a, b = self.symbols(rounds)
        last = np.searchsorted(b, a + phrase)
        whole = last < len(b)
        last = np.minimum(last, len(b) - 1)
        whole &= (self.doc[a] == self.doc[a[last]]) & (self.sizes[self.doc[a]] >= window)
        # A phrase is named symbol by symbol: all that have a next one go on.
        key, at = x.copy(), np.arange(len(x))
        going = np.flatnonzero(whole & (last > at))
        step = 1
        while len(going):
            key[going] = joined(key[going], x[going + step])
            step += 1
            going = going[last[going] >= going + step]
        end = b[last]
        thin = thinning(window, rounds, phrase)
        # Phrases of one document that are whole come first in it, so neighbours in the reduced list follow each other.
        a, end, key = a[whole], end[whole], key[whole]
        order, doc = mixed(key), self.doc[a]
        chosen = np.zeros(len(a), dtype=bool)
        if len(a) >= thin:
            n = len(a) - thin + 1
            best, least = np.zeros(n, dtype=np.int64), order[:n].copy()
            for k in range(1, thin):
                less = order[k:n + k] < least
                best[less], least[less] = k, order[k:n + k][less]
            inside = doc[:n] == doc[thin - 1:]
            chosen[(np.arange(n) + best)[inside]] = True
        twice = np.concatenate([[0], np.cumsum(self.x[1:] == self.x[:-1])])
        starts = self.windows(window)
        starts = starts[twice[starts + window - 1] > twice[starts]]
        special = self.x[starts]
        for k in range(1, window):
            special = joined(special, self.x[starts + k])
        return np.concatenate([key[chosen], special]), np.concatenate([a[chosen], starts]), np.concatenate([end[chosen], starts + window])

    def windows(self, window: int) -> np.ndarray:
        """Starts of all windows within one document."""
        if len(self.x) < window:
            return np.zeros(0, np.int64)
        at = np.arange(len(self.x) - window + 1)
        return at[self.doc[at] == self.doc[at + window - 1]]

    def covered(self, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        n = len(self.x) + 1
        return np.cumsum(np.bincount(starts, minlength=n) - np.bincount(starts + width, minlength=n))[:-1] > 0

    def holders(self, keys: np.ndarray, at: np.ndarray) -> Holders:
        return Holders(keys, self.ids[self.doc[at]], at)


class Holders:
    """Keys in order; of the documents that hold each the least and the largest id, and the first place in the least one."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, at: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, self.ids, self.at = keys[order], ids[order], at[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        cuts = np.flatnonzero(first)
        self.keys, self.number = keys[cuts], np.cumsum(first, dtype=np.int32) - 1
        self.least, self.largest = (f.reduceat(self.ids, cuts) if len(cuts) else self.ids for f in (np.minimum, np.maximum))
        holds = np.flatnonzero(self.ids == self.least[self.number])
        new = np.concatenate([[True], np.diff(self.number[holds]) > 0]) if len(holds) else np.zeros(0, bool)
        self.place = self.at[holds[new]]


def exact(texts: list[bytes | None], sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """A number for each word of the wanted texts, equal for equal words only; 0 for all words of the others."""
    numbers: dict[bytes, int] = {}
    out = np.zeros(int(sizes.sum()), dtype=np.int32)
    ends = np.cumsum(sizes)
    for d in np.flatnonzero(wanted).tolist():
        words = (texts[d] or b"").split()
        out[ends[d] - sizes[d]:ends[d]] = [numbers.setdefault(w, len(numbers) + 1) for w in words]
    return out


def stretches(places: np.ndarray, window: int) -> np.ndarray:
    """[start, end) of the words that windows at these places (rising) cover, as rows; windows that only touch stay apart."""
    if not len(places):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate([[True], places[1:] >= places[:-1] + window])
    cuts = np.flatnonzero(new)
    return np.stack([places[cuts], places[np.append(cuts[1:], len(places)) - 1] + window], axis=1)


def repeated(group: Group, window: int, own: int, texts: list[bytes | None]) -> np.ndarray:
    """Starts of the windows of the first `own` texts whose words are also in a text with a smaller id.

    Names pair each window with one that may be the same; their words are then compared one by one. Where they differ the
    windows of that name are told apart by their words.
    """
    starts = group.windows(window)
    if not len(starts):
        return starts
    keys = group.named(window)[starts]
    ordered = np.sort(keys)
    several = _within(keys, np.unique(ordered[1:][ordered[1:] == ordered[:-1]]))  # only names that occur twice matter
    del ordered
    held = group.holders(keys[several], starts[several])
    del keys, several, starts
    place, candidate = held.place[held.number], held.least[held.number] < held.ids
    at = np.flatnonzero(candidate)
    wanted = np.zeros(len(texts), dtype=bool)
    wanted[group.doc[held.at[at]]] = wanted[group.doc[place[at]]] = True
    words = exact(texts, group.sizes, wanted)
    same = np.zeros(len(held.at), dtype=bool)
    equal = np.ones(len(at), dtype=bool)
    for k in range(window):
        equal &= words[held.at[at] + k] == words[place[at] + k]
    same[at] = equal
    if not equal.all():
        odd = np.isin(held.number, np.unique(held.number[at[~equal]]))
        wanted[group.doc[held.at[odd]]] = True
        words = exact(texts, group.sizes, wanted)
        of: dict[tuple, int] = {}
        rows = [(tuple(words[p:p + window].tolist()), i, n) for p, i, n in zip(held.at[odd].tolist(), held.ids[odd].tolist(), np.flatnonzero(odd).tolist(), strict=True)]
        for w, i, _ in rows:
            of[w] = min(i, of.get(w, i))
        for w, i, n in rows:
            same[n] = of[w] < i
    found = held.at[same]
    return found[group.doc[found] < own]


def thinning(window: int, rounds: int, phrase: int) -> int:
    """How many phrases at least start and end within the consistent interior of a window."""
    symbol, interior = 1 << rounds, window - 2 * (1 << rounds)
    room = interior - (phrase + symbol - 1)
    if room < 0:
        raise ValueError("a window of so few words has no phrase in its interior after so many rounds")
    return room // symbol + 1


def pack(column: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of an 8-byte column, differences if it rises, transposed and compressed."""
    column = column.astype(np.uint64, copy=False) if rising else column.view(np.uint64)
    if rising:
        column = np.diff(column, prepend=np.uint64(0))
    return zstandard.compress(column.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    column = np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(column, dtype=np.uint64) if rising else column


def _dealt(group: int, keys: np.ndarray, buckets: int, *others: np.ndarray) -> pa.Table:
    """Sorted keys, and columns beside them, as one row for each bucket of keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(keys) else []
    rows = [(int(bucket[a]), pack(keys[a:b], True), *[pack(o[a:b]) for o in others]) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=False)]  # no key, no row
    columns = [pa.array([group] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[1 + k] for r in rows], pa.binary()) for k in range(1 + len(others))]]
    return pa.Table.from_arrays(columns, names=["g", "bucket", "keys", "ids"][:3 + len(others)])


def _returned(groups: list[int], keys: list[np.ndarray], wanted: np.ndarray) -> pa.Table:
    """The wanted keys (a mask over all, group after group) as one row for each group that has any."""
    rows, at = [], 0
    for g, k in zip(groups, keys, strict=True):
        some = k[wanted[at:at + len(k)]]
        at += len(k)
        if len(some):
            rows.append((g, pack(some, True)))
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["g", "keys"])


def _received(table: pa.Table) -> np.ndarray:
    parts = [unpack(x.as_py(), True) for x in table.column("keys")]
    return np.sort(np.concatenate([*parts, np.zeros(0, np.uint64)]))


def _within(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), dtype=bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _even(spark: SparkSession, groups: int, tasks: int, most: int = 1 << 14) -> list[int]:
    """Names for so many groups that a hash deals evenly to so many tasks; none for so many that chance is even enough."""
    if groups > most:
        return []
    drawn = spark.range(16 * groups + 64 * tasks).select(F.col("id").cast("int").alias("g")).select("g", F.pmod(F.hash("g"), F.lit(tasks)).alias("task"))
    found: dict[int, list[int]] = {}
    for r in drawn.collect():  # bounded by `most`
        found.setdefault(r["task"], []).append(r["g"])
    return [found[i % tasks][i // tasks] for i in range(groups)]


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, phrase: int = PHRASE) -> DataFrame:
    """One row per row of df: doc_id, n_words, removed (word ranges [start, end)), kept_text (kept words joined by a space).

    Removed is each word covered by a window of words that also starts in a document with a smaller id.
    """
    spark = df.sparkSession
    plain = df.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("binary").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    groups = max(tasks, 4 * -(-size // (4 * GROUP_BYTES)))
    buckets = max(4 * tasks, -(-2 * size // BUCKET_BYTES))
    number = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    dealt = plain.withColumn("g", F.get(F.array(*map(F.lit, even)), number) if (even := _even(spark, groups, tasks)) else number).repartition(tasks, "g")

    def opened(table: pa.Table) -> Group:
        return Group(table.column("text").to_pylist(), table.column("doc_id").to_pylist())

    def send_anchors(key, docs):
        group = opened(docs)
        keys, at, _ = group.anchors(window, rounds, phrase)
        held = group.holders(keys & ~np.uint64(1), at)
        return _dealt(key[0].as_py(), held.keys | (held.least != held.largest).astype(np.uint64), buckets)

    def share_anchors(key, table):
        held, keys = table.column("g").to_pylist(), [unpack(x.as_py(), True) for x in table.column("keys")]
        every = np.concatenate(keys)
        plain_key, several = every & ~np.uint64(1), every & np.uint64(1) == 1
        order = np.argsort(plain_key, kind="stable")
        same = plain_key[order][1:] == plain_key[order][:-1]
        twice = np.zeros(len(every), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        return _returned(held, [k & ~np.uint64(1) for k in keys], twice | several)

    def send_windows(key, docs, shared):
        if not docs.num_rows or not shared.num_rows:
            return _dealt(0, np.zeros(0, np.uint64), buckets, np.zeros(0, np.int64))
        group = opened(docs)
        starts = group.windows(window)
        if not len(starts):
            return _dealt(0, np.zeros(0, np.uint64), buckets, np.zeros(0, np.int64))
        keys, a, b = group.anchors(window, rounds, phrase)
        mine = _within(keys & ~np.uint64(1), _received(shared))
        first = np.maximum(b[mine] - window, 0)  # the windows that contain [a, b) start from b - window to a
        some = first <= a[mine]
        near = group.covered(first[some], (a[mine] + 1 - first)[some])
        starts = starts[near[starts]]
        held = group.holders(group.named(window)[starts], starts)
        return _dealt(key[0].as_py(), held.keys, buckets, held.least)

    def ask(key, table):
        """For each group that holds the least document of a window: which windows, and the groups that must see their words."""
        every = [unpack(x.as_py(), True) for x in table.column("keys")]
        of = np.repeat(table.column("g").to_numpy(), [len(k) for k in every])
        ids = np.concatenate([unpack(x.as_py()) for x in table.column("ids")]).view(np.int64)
        keys = np.concatenate(every)
        order = np.lexsort((of, ids, keys))
        keys, ids, of = keys[order], ids[order], of[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        cut = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = np.flatnonzero(ids[cut] < ids)
        keys, holder, to = keys[later], of[cut[later]], of[later]
        order = np.lexsort((to, keys, holder))
        keys, holder, to = keys[order], holder[order], to[order]
        cuts = (np.flatnonzero(holder[1:] != holder[:-1]) + 1).tolist()
        rows = [(int(holder[a]), pack(keys[a:b], True), pack(to[a:b].astype(np.int64))) for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True) if a < b]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["g", "keys", "to"])

    def send_words(key, docs, asked):
        out: list[tuple[int, bytes, list[int]]] = []
        if docs.num_rows and asked.num_rows:
            keys = np.concatenate([unpack(x.as_py(), True) for x in asked.column("keys")])
            to = np.concatenate([unpack(x.as_py()) for x in asked.column("to")]).view(np.int64)
            texts = docs.column("text").to_pylist()
            group = opened(docs)
            starts = group.windows(window)
            names_ = group.named(window)[starts]
            some = _within(names_, np.unique(keys))
            held = group.holders(names_[some], starts[some])
            place = held.place[np.searchsorted(held.keys, keys)]
            order = np.lexsort((place, to))
            place, to = place[order], to[order]
            cuts = (np.flatnonzero(to[1:] != to[:-1]) + 1).tolist()
            first = group.ends - group.sizes
            words: dict[int, list[bytes]] = {}
            for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
                lines, ids = [], []
                for s, e in stretches(np.unique(place[a:b]), window).tolist():
                    d = int(group.doc[s])
                    if d not in words:
                        words[d] = texts[d].split()
                    lines.append(b" ".join(words[d][s - first[d]:e - first[d]]))
                    ids.append(int(group.ids[d]))
                out.append((int(to[a]), zstandard.compress(b"\n".join(lines), 3), ids))
        return pa.Table.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["g", "words", "ids"])

    def finish(key, docs, received):
        texts = docs.column("text").to_pylist()
        others = [line for x in received.column("words") for line in zstandard.decompress(x.as_py()).split(b"\n")] if texts else []
        both = texts + others
        group = Group(both, [*docs.column("doc_id").to_pylist(), *(i for ids in received.column("ids").to_pylist() if texts for i in ids)])
        gone = group.covered(repeated(group, window, len(texts), both), window)
        removed, kept = [], []
        for text, a, b in zip(texts, (group.ends - group.sizes).tolist(), group.ends.tolist(), strict=False):
            out = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
            removed.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            words = (text or b"").split()
            kept.append(b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if len(edges) else words))
        return pa.Table.from_arrays([docs.column("doc_id"), pa.array(group.sizes[:len(texts)], pa.int64()), pa.array(removed, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "removed", "kept"])

    anchors = dealt.groupBy("g").applyInArrow(send_anchors, "g int, bucket int, keys binary")
    shared = anchors.groupBy("bucket").applyInArrow(share_anchors, "g int, keys binary")
    windows = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(send_windows, "g int, bucket int, keys binary, ids binary")
    asked = windows.groupBy("bucket").applyInArrow(ask, "g int, keys binary, to binary")
    sent = dealt.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(send_words, "g int, words binary, ids array<bigint>")
    result = dealt.groupBy("g").cogroup(sent.groupBy("g")).applyInArrow(finish, "doc_id bigint, n_words bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return result.select("doc_id", "n_words", "removed", F.col("kept").cast("string").alias("kept_text"))


def op4(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE least < doc_id),
marks AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

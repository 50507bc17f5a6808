"""SimHash near-duplicates: exact links within a Hamming radius, found in vantage-point trees.

Fingerprints are computed once per row and made distinct, so exact copies cost nothing further. Distances between
unrelated fingerprints on all 64 bits lie near 32 +- 4, so a cut with a boundary of 4 on either side would leave most on
both sides. A pair within 4 is however within 1 on a third of the bits at least; so there are three trees, each over the
Hamming distance on its third, with a boundary of 1.

A tree, grown from a bounded sample, partitions the fingerprints by their distance to vantage points: inner and outer
shards overlap at the boundary, so that each pair shares a shard of some tree. Shards are dealt out to tasks and searched
there one by one: further vantage points divide a shard, the triangle inequality prunes, leaves are compared on all 64
bits. Members within the radius of a vantage point are linked by that alone, and members known to be connected are not
compared; so a crowd of near copies that no distance divides isn't compared pair by pair. Shards of many more
fingerprints than planned, which such crowds make, are dealt out as pairs of chunks, about as many rows in each as there are.

A task sends one spanning forest of a shard's links, never all pairs of a group; components then grow by star
contractions. Nothing is collected to the driver but the sample and the sizes of crowded shards.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; fewer than `shingle` words are one
shingle; repeated rows are rows of the same fingerprint; a null id is never a component's name, a component without any
id has none; an empty table is empty.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import connected_components
from veilframe.llm.shared import chunks, documents, materialize, named

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Fingerprints that trees are grown from, at most; the size of a shard that they aim at; from what size on a shard is dealt out in chunks.
SAMPLE, SHARD, CROWD = 1 << 14, 4096, 1 << 14
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, n = ends - sizes, min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """df with _fp, the fingerprint as a signed number, in place of text_col."""
    from pyspark.sql import types as T

    plain = df.withColumn(text_col, F.col(text_col).cast("binary"))

    def hashed(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                found = np.array([fingerprint(t.as_py(), shingle) for t in part.column(text_col)], dtype=np.uint64).view(np.int64)
                yield part.select([c for c in part.schema.names if c != text_col]).append_column("_fp", pa.array(found))

    return plain.mapInArrow(hashed, T.StructType([*plain.drop(text_col).schema, T.StructField("_fp", T.LongType())]))


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def projections(radius: int) -> list[tuple[int, int]]:
    """(mask, slack): bits of each tree, and how far apart a pair within radius can be there in one of them at least."""
    k = radius // 2 + 1
    cuts = [64 * i // k for i in range(k + 1)]
    return [(((1 << b) - 1) ^ ((1 << a) - 1), radius // k) for a, b in zip(cuts, cuts[1:], strict=False)]


class Tree:
    """A vantage-point tree that deals fingerprints into shards by their Hamming distance under a mask.

    Inner are those at distance `cut` at most, outer the others and those within `slack` of the cut: by the triangle
    inequality two fingerprints within slack of each other share a shard. It is grown from a sample and deals out any.
    """

    TRIED = 8

    def __init__(self, sample: np.ndarray, mask: int, slack: int, most: int, first: int = 0):
        self.mask, self.slack, self.shards = np.uint64(mask), slack, first
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.root = self._grown(sample, most)

    def _grown(self, sample: np.ndarray, most: int) -> int:
        """A node's number, or the complement of a shard's."""
        best = None
        if len(sample) > most:
            for vantage in sample[:: max(1, len(sample) // self.TRIED)]:
                d = _count((sample ^ vantage) & self.mask)
                for cut in {int(np.median(d)), int(np.median(d)) - 1}:
                    larger = max((d <= cut).sum(), (d > cut - self.slack).sum())
                    if best is None or larger < best[0]:
                        best = larger, vantage, cut, d
        if best is None or best[0] == len(sample):
            self.shards += 1
            return ~(self.shards - 1)
        _, vantage, cut, d = best
        self.nodes.append((vantage, cut, 0, 0))
        at = len(self.nodes) - 1
        self.nodes[at] = (vantage, cut, self._grown(sample[d <= cut], most), self._grown(sample[d > cut - self.slack], most))
        return at

    def deal(self, points: np.ndarray):
        """(shard, places in points) for every shard that gets any."""
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at
                continue
            vantage, cut, inner, outer = self.nodes[node]
            d = _count((points[at] ^ vantage) & self.mask)
            stack += [(inner, at[d <= cut]), (outer, at[d > cut - self.slack])]


class Links:
    """The vantage-point search within a shard, keeping one spanning forest of all links found.

    Pairs within `radius` are found if they are within `slack` under `mask`. What the triangle inequality rules out, or
    what is known to be connected, is not compared.
    """

    LEAF = 512

    def __init__(self, points: np.ndarray, radius: int, mask: int = (1 << 64) - 1, slack: int | None = None):
        self.points, self.radius, self.mask, self.slack = points, radius, np.uint64(mask), radius if slack is None else slack
        self.parent = np.arange(len(points))
        self.compared = 0

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while not np.array_equal(again := self.parent[found], found):
            found = again
        self.parent[at] = found
        return found

    def join(self, members: np.ndarray) -> None:
        roots = self.roots(members)
        self.parent[roots] = roots.min()

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """All pairs of two small sets, unless they are known to be connected."""
        rl, rr = self.roots(left), self.roots(right)
        if (rl == rl[0]).all() and (rr == rl[0]).all():
            return
        self.compared += len(left) * len(right)
        near = np.bitwise_count(self.points[left][:, None] ^ self.points[right][None, :]) <= self.radius
        near &= rl[:, None] != rr[None, :]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            self.join(np.append(right[near[i]], left[i]))

    def _crowd(self, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs of two sets that no vantage point divides, less those within the largest component of the right one."""
        rl, rr = self.roots(left), self.roots(right)
        names, sizes = np.unique(rr, return_counts=True)
        most = names[sizes.argmax()]
        for l, r in ((left[rl != most], right), (left[rl == most], right[rr != most])):
            for a in range(0, len(l), self.LEAF):
                for b in range(0, len(r), self.LEAF):
                    self.compare(l[a:a + self.LEAF], r[b:b + self.LEAF])

    def search(self, left: np.ndarray, right: np.ndarray) -> None:
        """All pairs of left and right: divide both by distance to a vantage point, skip what the triangle rules out."""
        stack = [(left, right)]
        while stack:
            left, right = stack.pop()
            same = left is right
            if not len(left) or not len(right):
                continue
            if len(left) * len(right) <= self.LEAF ** 2:
                self.compare(left, right)
                continue
            first = self.roots(left[:1])[0]
            if (self.roots(left) == first).all() and (same or (self.roots(right) == first).all()):
                continue
            longer = left if len(left) >= len(right) else right
            at = longer[len(longer) // 2]
            vantage = self.points[at]
            for side in (left,) if same else (left, right):
                self.join(np.append(side[np.bitwise_count(self.points[side] ^ vantage) <= self.radius], at))
            if not any(self._divide(stack, left, right, vantage, mask, slack) for mask, slack in ((self.mask, self.slack), (np.uint64((1 << 64) - 1), self.radius))):
                self._crowd(left, right)

    def _divide(self, stack: list, left: np.ndarray, right: np.ndarray, vantage: np.uint64, mask: np.uint64, slack: int) -> bool:
        """Put the parts of left and right that can hold pairs on the stack; false if that would be all of them."""
        same = left is right
        dl = _count((self.points[left] ^ vantage) & mask)
        dr = dl if same else _count((self.points[right] ^ vantage) & mask)
        edge = int(np.median(dl if len(left) >= len(right) else dr))
        if min(dl.min(), dr.min()) > edge - slack and max(dl.max(), dr.max()) <= edge + slack or max(dl.max(), dr.max()) <= edge:
            return False
        li, ri = dl <= edge, dr <= edge
        inner, outer = left[li], left[~li]
        stack += [(inner, inner if same else right[ri]), (outer, outer if same else right[~ri])]
        # Across the boundary only distances that differ by the slack at most can belong to a pair.
        stack.append((left[li & (dl > edge - slack)], right[~ri & (dr <= edge + slack)]))
        if not same:
            stack.append((left[~li & (dl <= edge + slack)], right[ri & (dr > edge - slack)]))
        return True


def forest(distinct: DataFrame, n: int, radius: int, shard: int) -> list[Tree]:
    """A tree for each projection, grown from a sample of SAMPLE fingerprints at most, with shards of about `shard` or less."""
    sample = np.zeros(0, np.uint64)
    if n > shard:
        drawn = distinct.orderBy(F.xxhash64("_fp", F.lit("sample"))).limit(SAMPLE).collect()
        sample = np.array([r["_fp"] for r in drawn], dtype=np.int64).view(np.uint64)
    most = max(16, len(sample) * shard // max(n, 1))
    trees: list[Tree] = []
    for mask, slack in projections(radius):
        trees.append(Tree(sample, mask, slack, most, trees[-1].shards if trees else 0))
    return trees


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of the fingerprints in column _fp (distinct, stored) that connect all within radius of each other."""
    spark = distinct.sparkSession
    trees = spark.sparkContext.broadcast(forest(distinct, distinct.count(), radius, shard))  # bounded by SAMPLE
    last = [t.shards for t in trees.value]

    def sizes(batches):
        total = np.zeros(last[-1], dtype=np.int64)
        for batch in batches:
            points = batch.column("_fp").to_numpy().view(np.uint64)
            for tree in trees.value:
                for number, at in tree.deal(points):
                    total[number] += len(at)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["shard", "n"])

    # A row a shard at most, and of shards only those that no vantage point could divide.
    crowded = distinct.select("_fp").mapInArrow(sizes, "shard int, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).filter(F.col("n") > crowd)
    chunks_of = {r["shard"]: ceil(sqrt(4 * r["n"] / crowd)) for r in crowded.collect()}

    def deal(batches):
        """Rows of shards; of a crowded shard each of its chunks meets every chunk, so a row goes to as many parts."""
        for batch in batches:
            points = batch.column("_fp").to_numpy().view(np.uint64)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for tree in trees.value:
                for number, at in tree.deal(points):
                    c = chunks_of.get(number, 1)
                    own = ((points[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(c) if c > 1 else np.zeros(len(at), np.uint64)
                    for other in range(c):
                        lo, hi = np.minimum(own, other), np.maximum(own, other)
                        for column, x in zip(out, (np.full(len(at), number), lo * np.uint64(c) + hi, (own == hi) & (lo != hi), points[at]), strict=True):
                            column.append(x)
            shards, parts, sides, values = (np.concatenate(x) if x else np.zeros(0) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(parts.astype(np.int64)), pa.array(sides.astype(bool)), pa.array(values.astype(np.uint64).view(np.int64))], names=["shard", "part", "side", "_fp"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("_fp").mapInArrow(deal, "shard int, part bigint, side boolean, _fp bigint").repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part")

    def search(batches):
        for number, side, points in parts(batches):
            mask, slack = projections(radius)[np.searchsorted(last, number, side="right")]
            found = Links(points, radius, mask, slack)
            every = np.arange(len(points))
            found.search(every if not side.any() else every[~side], every if not side.any() else every[side])
            root = found.roots(every)
            linked = np.flatnonzero(root != every)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(points[linked].view(np.int64)), pa.array(points[root[linked]].view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(search, "a bigint, b bigint")


def parts(batches):
    """(shard, sides, points) of each part of sorted batches; one part is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None

    def whole():
        side, fp = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("side", "_fp"))
        return key[0], side.astype(bool), fp.view(np.uint64)

    for batch in batches:
        shard, part = (batch.column(c).to_numpy() for c in ("shard", "part"))
        new = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(shard)], strict=True):
            if a == b:
                continue
            if held and (shard[a], part[a]) != key:
                yield whole()
                held = []
            key = (shard[a], part[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _components(rows: DataFrame, radius: int, first: Column) -> DataFrame:
    """(_fp, _first): for each distinct _fp of the stored rows the least value of `first` in its component."""
    distinct = materialize(rows.groupBy("_fp").agg(F.min(first).alias("_own")), "fingerprints")
    roots = connected_components(links(distinct.select("_fp"), radius))
    rooted = materialize(distinct.join(roots.select(F.col("node").alias("_fp"), "root"), "_fp", "left").select("_fp", F.coalesce("root", "_fp").alias("_root"), "_own"), "roots")
    least = materialize(rooted.groupBy("_root").agg(F.min("_own").alias("_first")), "firsts")
    return materialize(rooted.join(least.hint("merge"), "_root").select("_fp", "_first"), "components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach)."""
    plain = df.select(named(id_col).alias("doc_id"), named(text_col).alias("_text"))
    rows = materialize(with_fingerprints(plain, "_text", shingle), "simhash")
    out = rows.join(_components(rows, radius, F.col("doc_id")).hint("merge"), "_fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_first").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, broadcast_rows: int = 1 << 20) -> DataFrame:
    """df with one row of each component: that of the least id, null ids last, the first stored among equal ids.

    The rows that go are found by number, and leave the stored rows by an anti join: at most `broadcast_rows` numbers are
    sent to every executor, so that no text moves; more are joined by a shuffle.
    """
    cols = df.columns
    plain = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    at, key = (f"_c{cols.index(c)}" for c in (text_col, id_col))
    stored = materialize(with_fingerprints(plain.withColumn("_text", F.col(at)), "_text", shingle).withColumn("_row", F.monotonically_increasing_id()), "simhash")
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_row").alias("row"))
    rows = stored.select(key, "_fp", "_row")
    go = rows.join(_components(rows, radius, first).hint("merge"), "_fp").filter("_row <> _first.row").select("_row")
    go = materialize(go, "copies")
    go = F.broadcast(go) if go.count() <= broadcast_rows else go.hint("merge")
    return stored.join(go, "_row", "left_anti").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))

import random
import re

import numpy as np
import xxhash

from veilframe.llm import simhash as S
from veilframe.llm.components import connected_components

DOCS = "doc_id bigint, text string, _fp string, _text int"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=4):
    parent = {p: p for p in points}
    find = lambda x: x if parent[x] == x else find(parent[x])
    arr = np.array(sorted(points), dtype=np.uint64)
    for i, p in enumerate(arr):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ p) <= radius):
            a, b = find(int(p)), find(int(arr[i + 1 + j]))
            parent[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(set(fps))
    least = {}
    for (d, _), f in zip(rows, fps):
        least[roots[f]] = min([x for x in (d, least.get(roots[f])) if x is not None], default=None)
    return sorted(((d, f"{f:016x}", least[roots[f]]) for (d, _), f in zip(rows, fps)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=rng.choice([3, 40, 300]))) for _ in range(150)]
    for _ in range(250):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    return texts


def test_matches_brute_force(spark):
    rows = [(i + 5, t) for i, t in enumerate(corpus(1))]
    rows += [(2000, None), (1, ""), (2, " \n\t"), (None, rows[0][1]), (None, "only null"), (3, "A\xa0b C d é"), (3, "A\xa0b C d é"), (4, "a " * 70_000), (9000, "UPPER case TEXT here now"), (9001, "upper CASE text here now")]
    got = S.near_duplicates(spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_documents_match_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op2(spark, d).collect()), key=str) == expected(rows)


def test_search_prunes_nothing_that_links():
    rng = np.random.default_rng(2)
    for crowd in (0, 900):
        base = rng.integers(0, 2 ** 64, 1500, dtype=np.uint64)
        near = base[:400] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(400)], dtype=np.uint64)
        hot = np.uint64(12345) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(crowd)], dtype=np.uint64) if crowd else base[:0]
        points = np.unique(np.concatenate([base, near, hot]))
        links = S.Links(points, 4)
        links.LEAF = 16
        everything = np.arange(len(points))
        links.search(everything, everything)
        want = brute_components([int(p) for p in points])
        got = {int(points[i]): int(points[r]) for i, r in enumerate(links.roots(everything))}
        assert got == want


def signed(points):
    return [(p - (1 << 64) if p >> 63 else p,) for p in points]


def groups(points, roots):
    out = {}
    for p in points:
        out.setdefault(roots.get(p, p), []).append(p)
    return sorted(map(sorted, out.values()))


def test_shards_and_chunks_of_any_size_find_the_same(spark):
    rng = random.Random(4)
    crowd = {(0xABC << 40) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(900)}
    points = sorted(crowd | {rng.randrange(1 << 64) for _ in range(600)})
    df = spark.createDataFrame(signed(points), "_fp bigint").repartition(3)
    want = groups(points, brute_components(points))
    for options in ({}, {"shard": 100, "crowd": 50}, {"shard": 40}, {"crowd": 300}):
        roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in connected_components(S.links(df, **options)).collect()}
        assert groups(points, roots) == want, options


def test_pairs_within_the_radius_share_a_shard():
    rng = np.random.default_rng(5)
    for radius in (0, 1, 2, 3, 4, 7):
        points = rng.integers(0, 2**64, 2000, dtype=np.uint64)
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False)) for _ in points], dtype=np.uint64)
        sample = rng.permutation(points)[:500]
        met = np.zeros(len(points), bool)
        sizes = []
        for mask, slack in S.projections(radius):
            tree = S.Tree(sample, mask, slack, 30)
            for _, at in tree.deal(np.concatenate([points, points ^ flips])):
                sizes.append(len(at))
                here = np.zeros(2 * len(points), bool)
                here[at] = True
                met |= here[:2000] & here[2000:]
        assert met.all() and max(sizes) < 2000, radius


def test_crowds_are_not_compared_pair_by_pair():
    rng = np.random.default_rng(6)
    points = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(20_000)], dtype=np.uint64))
    found = S.Links(points, 4, *S.projections(4)[0])
    every = np.arange(len(points))
    found.search(every, every)
    assert len(np.unique(found.roots(every))) == 1 and found.compared < len(points) ** 2 / 4


def test_parts_come_one_at_a_time():
    import pyarrow as pa

    rows = [(1, 0, False, 5), (1, 0, False, 6), (1, 2, False, 7), (1, 2, True, 8), (4, 0, False, 9)]
    table = pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "part": [r[1] for r in rows], "side": [r[2] for r in rows], "_fp": [r[3] for r in rows]})
    for size in (1, 2, 3, 5):
        got = [(int(k), s.tolist(), p.tolist()) for k, s, p in S.parts(iter(table.to_batches(max_chunksize=size)))]
        assert got == [(1, [False, False], [5, 6]), (1, [False, True], [7, 8]), (4, [False], [9])]
    assert list(S.parts(iter([]))) == []


def test_vantage_points_prune_on_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").repartition(8)
    points = np.array(sorted({r["_fp"] % (1 << 64) for r in S.with_fingerprints(docs, "text").collect()}), dtype=np.uint64)
    trees = [S.Tree(points, mask, slack, 2000) for mask, slack in S.projections(4)]
    compared, links = 0, []
    for tree, (mask, slack) in zip(trees, S.projections(4)):
        for _, at in tree.deal(points):
            shard = points[at]
            assert len(shard) < len(points)
            found, every = S.Links(shard, 4, mask, slack), np.arange(len(shard))
            found.search(every, every)
            compared += found.compared
            links += zip(shard.tolist(), shard[found.roots(every)].tolist())
    assert compared < len(points) ** 2 / 3  # of all ordered pairs two thirds at least are ruled out, over all three trees
    parent = {p: p for p in points.tolist()}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {p: find(p) for p in parent} == brute_components(points.tolist())


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100} | {i: 100 for i in range(101, 400)} | {1000: 1000, 1001: 1000}


def test_one_row_of_each_component_stays(spark):
    rows = [(5, "same text of several words", "c", 1), (3, "same text of several words", None, 2), (3, "same text of several words", "c", 3), (None, "same text of several words", "c", 4), (None, "alone", "c", 5), (8, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, S.drop_near_duplicates(df, broadcast_rows=0).collect()))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is not None) == [(3, "same text of several words"), (8, None)]
    assert out.count() == 3 and S.drop_near_duplicates(df.limit(0)).count() == 0 and S.near_duplicates(df.limit(0)).count() == 0

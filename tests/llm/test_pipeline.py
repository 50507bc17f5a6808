import hashlib
from collections import Counter

import corpus_pipeline as C
from veilframe.llm.shared import made_since
from test_decontaminate import tokens
from test_quality_rules import counts, judged, maximised, rule_votes
from test_secrets import base
from test_simhash import expected as components


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, stages = docs.columns, dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]

    def stage(name, df):
        out = spark.createDataFrame(stages[name](spark, df, d).collect(), df.schema)
        assert out.columns == columns
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    first, kept = stage("quality_rules", docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    votes = {k: rule_votes(t) for k, t in texts.items()}
    model = maximised(sorted(Counter(votes.values()).items()))
    failed = {k: n < 10 or 100 * repeats > 20 * n for k, t in texts.items() for n, _, _, _, repeats in [counts(t)]}
    assert set(kept) == {k for k in texts if not failed[k] and judged(votes[k], model) >= 0.5}

    second, unique = stage("simhash_near_dedup", first)
    assert set(unique) == {c for _, _, c in components(list(kept.items()))}

    third, clean = stage("benchmark_decontamination", second)
    windows = set()
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        b = tokens(r["text"])
        n = min(10, len(b))
        windows |= {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    dirty = {k for k, t in unique.items() if any(tuple(w[i:i + n]) in windows for w in [tokens(t)] for n in sizes for i in range(len(w) - n + 1))}
    assert set(clean) == set(unique) - dirty and dirty

    fourth, safe = stage("secret_scan", third)
    assert set(safe) == set(clean) and not any(base(t) for t in safe.values())
    assert all(safe[k] == t for k, t in clean.items() if not base(t) and "[SECRET]" not in safe[k])

    packed = stages["best_fit_packing"](spark, fourth, d).collect()
    assert {r["doc_id"] for r in packed} == set(safe)
    stored = len(made_since())
    whole = C.run(spark, d).collect()
    assert len(made_since()) <= stored + 2  # the last stage's rows and its pieces; what came before is dropped
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert key(whole) == key(packed)


def test_stages_on_hard_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _f string, _judged0 int"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", None, 0, "x", 1), (1, "good words " * 40, None, "a", None, None, 2), (1, "good words " * 40, None, "a", None, None, 2), (2, "the long and the short of it " * 30_000, "en", "b", 1, "", 3)]
    rows += [(i, f"the quick tale of number {hashlib.md5(str(i).encode()).hexdigest()[:12]} and of all that is in it for the reader to find and to keep", "en", "c", 1, "", 1) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, schema)
    for df in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, df, "/root/testdata/sf0.001")
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            n = out.count()
            assert n <= max(df.count(), 1) * 400
            if not df.count():
                assert n == 0

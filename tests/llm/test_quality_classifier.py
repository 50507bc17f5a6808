import math
import re
import zlib

import pytest
import random

import numpy as np

from veilframe.llm import quality_classifier as Q

SCHEMA = "doc_id bigint, text string, grade int, _quality string"


def sample(n, seed=0):
    rng, common = random.Random(seed), [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        grade = rng.randrange(3)
        words = rng.choices(common, k=30) + rng.choices([["awful", "dreadful"], ["middling", "passable"], ["superb", "splendid"]][grade], k=2)
        rng.shuffle(words)
        rows.append((i, " ".join(words), grade, "clash"))
    return rows


def test_grades_are_recovered_in_order(spark):
    df = spark.createDataFrame(sample(1500), SCHEMA)
    model = Q.train(df, grades=3)
    assert np.all(np.diff(model.thresholds) > 0)
    got = Q.classify(df, model, keep_grade=2, keep_cols=["doc_id", "grade"]).collect()
    assert len(got) == 1500
    by = {g: [r["_quality"] for r in got if r["grade"] == g and Q_held(r["doc_id"])] for g in range(3)}
    means = [np.mean([q["expected_grade"] for q in by[g]]) for g in range(3)]
    assert means[0] < 0.6 < means[1] < 1.5 < means[2]
    assert np.mean([q["kept"] for q in by[2]]) > 0.95 and np.mean([q["kept"] for q in by[0]]) < 0.05


def Q_held(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_defined_cases(spark):
    rows = [(1, None, 0, ""), (2, "", 2, ""), (None, "superb", 2, ""), (3, "superb " * 50_000, None, ""), (4, "superb", 9, ""), (4, "superb", 9, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for model in (Q.train(df, 3), Q.train(df.limit(0), 3)):
        got = Q.classify(df, model, 2, keep_cols=["doc_id"]).collect()
        assert len(got) == len(rows) and all(0 <= r["_quality"]["tail_prob"] <= 1 for r in got)
    assert abs(got[0]["_quality"]["expected_grade"] - 1) < 1e-9
    assert Q.classify(df.limit(0), model, 2).count() == 0


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    n = {(r["q"], r["kept"]): r["count"] for r in Q.op5(spark, d).filter("held_out").join(labels, "doc_id").selectExpr("quality * 2 + toxic AS q", "kept").groupBy("q", "kept").count().collect()}
    assert n.get((2, True), 0) >= 0.95 * (n.get((2, True), 0) + n.get((2, False), 0))
    assert n.get((0, False), 0) >= 0.7 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_scores_match_the_exported_weights(spark):
    """Grade probabilities written out from weights and thresholds, feature by feature."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = Q.train(Q.graded(docs, spark.read.parquet(f"{d}/labels.parquet")), grades=3)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in Q.op5(spark, d).collect()}
    assert set(got) == set(texts) and len(model.weights) > 10 and list(model.thresholds) == sorted(model.thresholds)
    for k, t in texts.items():
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", t)]
        found = set(words) | {f"\x03{w[:n]}" for w in words for n in (4, 5) if len(w) > n}
        for m in re.findall(r"[^\w\s]+", t):
            seen = ""
            for c in m:
                seen += c if c not in seen else ""
            found.add(f"\x02{seen}{len(m).bit_length()}")
        lines = [x for x in t.split("\n") if x.strip()]
        upper = [w for w in re.findall(r"[^\W\d_]+", t) if len(w) > 1 and w.isupper()]
        found |= {f"\x01pairs{min(10, 10 * len(set(zip(words, words[1:]))) // max(1, len(words) - 1))}", f"\x01lines{10 * len(set(lines)) // max(1, len(lines))}", f"\x01capitals{10 * len(upper) // max(1, len(words))}", f"\x01size{len(words).bit_length()}"}
        x = sum(model.weights.get(zlib.crc32(f.encode()) % (1 << Q.HASH_BITS), 0.0) for f in found)
        at_most = [1 / (1 + math.exp(-(th - x))) for th in model.thresholds]
        grade = sum(g * p for g, p in enumerate([at_most[0], at_most[1] - at_most[0], 1 - at_most[1]]))
        assert got[k]["expected_grade"] == pytest.approx(grade, abs=1e-6) and got[k]["tail_prob"] == pytest.approx(1 - at_most[1], abs=1e-6)
        assert got[k]["kept"] == (got[k]["tail_prob"] >= 0.4)

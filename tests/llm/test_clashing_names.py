"""Operators given columns of the very names they use themselves: nothing is lost, nothing is ambiguous."""

import pytest
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, language_id, packing, quality_classifier, quality_rules, secrets, simhash, substring_dedup, token_counts

NAMES = ["_f", "kept", "_c0", "_C1", "_text", "_hits", "_language", "_quality", "_tokens", "_base", "_spans", "n_live", "_fp", "_row", "_id", "_v", "g", "piece", "length", "a b", "x`y", "dotted.name", "grade"]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(["the cat and the dog", None, "", "password = abcdefghijklmnop the end", "the cat and the dog"])]
    out = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return out.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def bench(spark):
    return spark.createDataFrame([(1, "the cat and")], "item_id bigint, text string")


OPERATORS = {
    "rules": lambda s, d: quality_rules.quality_rules(d), "secrets": lambda s, d: secrets.scan_secrets(d), "redact": lambda s, d: secrets.redact_secrets(d),
    "hits": lambda s, d: decontaminate.benchmark_hits(d, bench(s)), "joined": lambda s, d: decontaminate.benchmark_hits(d, bench(s), max_index_bytes=0),
    "language": lambda s, d: language_id.predict(d, language_id.train(d)), "quality": lambda s, d: quality_classifier.classify(d, quality_classifier.fit([], 3), 2),
    "tokens": lambda s, d: token_counts.token_counts(d), "drop": lambda s, d: simhash.drop_near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_kept_columns_survive(spark, df, name, tmp_path):
    out = OPERATORS[name](spark, df)
    assert out.columns[:len(df.columns)] == df.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert all(r[f"{n}"] == f"own {n}" for r in rows for n in NAMES)
    assert len(rows) == (3 if name == "drop" else 5)


def test_fixed_results_take_any_table(spark, df):
    assert packing.best_fit_packing(df).count() == 5
    assert simhash.near_duplicates(df).count() == 5
    assert substring_dedup.substring_dedup(df).count() == 5

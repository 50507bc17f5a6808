"""Queries beside their SQL, and what the entry point offers."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from veilframe.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(repr, db.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()))


def test_entry_point_has_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(registry.ORACLES) <= set(entry.oracle_sql())


def test_the_rest_does_not_import_this_folder():
    root = os.path.dirname(os.path.dirname(registry.__file__))
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py") and "llm" not in folder:
                assert "veilframe.llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f

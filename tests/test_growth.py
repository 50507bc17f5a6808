"""Long texts: time must grow about as the text does. A doubling may take 2.5 times as long, plus half a second for what any run has."""

import re
import time

import pytest
from pyspark.sql import functions as F

from veilframe.functions.offsets import located, running
from veilframe.operators.detect import detect, resolve_overlaps
from veilframe.operators.mask import splice

TEXTS = {
    "addresses": lambda n: " ".join(f"u{i}@ex{i % 97}.com" for i in range(n)),
    "phones": lambda n: " ".join("0532 123 45 67" for _ in range(n)),
    "digits in one run": lambda n: "1a" * n,
    "digits in one run, a special character elsewhere": lambda n: "1a" * n + " !x",
    "dots before a sign": lambda n: "a." * n + "@b",
    "dots after a sign": lambda n: "x@" + "a." * n,
    "dots and a sign": lambda n: "x@ " + "a." * n,
}


@pytest.mark.parametrize("name", TEXTS)
def test_detection_grows_with_the_text(spark, name):
    seconds = []
    for n in (500, 16_000, 32_000, 64_000):
        df = spark.createDataFrame([(TEXTS[name](n),)], "t string")
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            df.select(F.size(detect(F.col("t")))).collect()
            best = min(best, time.perf_counter() - began)
        seconds.append(best)
    assert seconds[2] < 2.5 * seconds[1] + 0.5 and seconds[3] < 2.5 * seconds[2] + 0.5, seconds


def test_running_totals(spark):
    for n in (1, 2, 3, 10, 101):
        values = [(7 * i) % 11 - 3 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        total, most = df.select(running(F.col("v")), running(F.col("v"), F.greatest)).first()
        assert total == [sum(values[:i + 1]) for i in range(n)] and most == [max(values[:i + 1]) for i in range(n)]


def test_neighbours_may_belong_to_another_match(spark):
    text = "12ab34cd5😀67"
    row = spark.createDataFrame([(text,)], "t string").select(located(F.col("t"), "[0-9]{1,2}|[a-z]", neighbours=True)).first()[0]
    want = [(m.start(), m.end(), m[0], m[0], text[m.start() - 1] if m.start() else "", text[m.end():m.end() + 1]) for m in re.finditer("[0-9]{1,2}|[a-z]", text)]
    assert [tuple(r) for r in row] == want


def test_many_overlaps_and_pieces(spark):
    spans = [(i * 3 % 1000, -(i % 7 + 1), i % 8, str(i)) for i in range(2000)]
    kept, end = [], 0
    for s in sorted(spans):
        if s[0] >= end:
            kept.append(s)
            end = s[0] - s[1]
    df = spark.createDataFrame([(spans, "x" * 1100)], "m array<struct<start:int,neg_length:int,kind_ord:int,value:string>>, t string")
    assert [tuple(r) for r in df.select(resolve_overlaps(F.col("m"))).first()[0]] == kept
    pieces = F.transform(resolve_overlaps(F.col("m")), lambda m: F.struct(m["start"].alias("start"), (m["start"] - m["neg_length"]).alias("end"), m["value"].alias("put")))
    text, at, out = "x" * 1100, 0, ""
    for s in kept:
        out, at = out + text[at:s[0]] + s[3], s[0] - s[1]
    assert df.select(splice(F.col("t"), pieces)).first()[0] == out + text[at:]

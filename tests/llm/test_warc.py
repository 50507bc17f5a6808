import glob
import gzip
import hashlib
import random
import re

from veilframe.llm import warc as W

PAGES = "page_id bigint, url string, html string, digest string, n int"
BIG = "<p>x</p>" * 200


def test_losers_tree_merges_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((f"u{rng.randint(0, 9)}", f"t{rng.randint(0, 3)}", rng.randint(0, 99)) for _ in range(rng.choice([0, 1, 30]))), key=W.order) for _ in range(k)]
        assert list(W.merge_runs(runs)) == sorted((x for r in runs for x in r), key=W.order)


def test_url_keys():
    assert W.url_key("http://www.Example.com/A?b=C") == W.url_key("https://example.com/a?b=c") == "com,example)/a?b=c"
    assert W.url_key("") == ")/" and W.url_key("http://[bad") == "http://[bad"


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a.org/", BIG), (2, "http://b.org/", BIG), (3, "http://b.org/", BIG), (3, "http://b.org/", BIG), (4, None, None), (5, "http://c.org/x\ny", "small"), (6, "http://c.org/", "small"), (None, "http://d.org", BIG), (None, "http://e.org", "é😀\r\n\r\nWARC/1.1\r\n" * 100), (None, "http://f.org", "é😀\r\n\r\nWARC/1.1\r\n" * 100), (7, "http://g.org", "y" * 3_000_000), (8, "u", W.EMPTY_MEMBER.decode("latin-1") * 60)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(3)
    path = str(tmp_path / "archives")
    got = W.capture_index(df, path).collect()
    assert [W.order((r["url_key"], r["captured"], r["page_id"])) for r in got] == sorted(W.order((r["url_key"], r["captured"], r["page_id"])) for r in got)
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    big, odd = len(BIG), len(("é😀\r\n\r\nWARC/1.1\r\n" * 100).encode())
    assert kinds[:3] == [(0, "response", None, odd), (0, "response", None, odd), (0, "revisit", 3, big)]
    assert kinds[3:] == [(1, "revisit", 3, big), (2, "revisit", 3, big), (3, "response", None, big), (3, "response", None, big), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5), (7, "response", None, 3_000_000), (8, "response", None, len(rows[-1][2].encode()))]
    assert {r["payload_digest"] for r in got if r["page_id"] == 5} == {hashlib.sha1(b"small").hexdigest()}
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{path}/part-*"))
    assert data.count(b"WARC-Type: ") == len(rows) and BIG.encode() in data
    ids = re.findall(rb"WARC-Record-ID: (\S+)", data)
    assert len(set(ids)) == len(rows)


def test_many_short_runs_merge_in_any_ranges(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(50)}", f"t{rng.randrange(4)}", rng.choice([None, rng.randrange(1000)]), 5, "d", "response", None) for _ in range(3000)]
    runs = []
    for run in range(60):
        runs += [(run, i, *r) for i, r in enumerate(sorted(rows[run::60], key=W.order))]
    df = spark.createDataFrame(runs, W.RUN).repartition(5)
    for options in ({}, {"ranges": 1}, {"range_bytes": 20_000}):
        assert [tuple(r)[:3] for r in W.merged_index(df, **options).collect()] == [r[:3] for r in sorted(rows, key=W.order)]


def test_empty_table(spark):
    assert W.capture_index(spark.createDataFrame([], PAGES)).count() == 0

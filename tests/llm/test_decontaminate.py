import hashlib
import re

from veilframe.llm import decontaminate as D

DOCS = "doc_id bigint, text string, _text string, _hits string"
ITEMS = "item_id bigint, text string"
ITEM = "The quick brown fox jumps over the lazy dog near 42 old été barns"
BENCH = [(7, ITEM), (10, "short item"), (2, None), (3, " .,! "), (None, "no id words here"), (11, "short, ITEM"), (10, "short item"), (5, "a a a a a a a a a a a a")]
TEXTS = [
    None, "", "...", "short item", "x SHORT-item y short item", "the quick brown fox jumps over the lazy dog near", "quick brown fox jumps over the lazy dog near 43",
    "pre " + ITEM.upper() + " post", "a " * 9, "a " * 25, "no id words here", "so no id words here: " * 5_000, "été " + ITEM + " " + ITEM, "short\x00item été",
]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text):
    words, hit, items = tokens(text), set(), set()
    for item, t in BENCH:
        b = tokens(t)
        n = min(10, len(b))
        wins = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                items |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_matches_brute_force_on_both_paths(spark):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], DOCS)
    bench = spark.createDataFrame(BENCH, ITEMS)
    for bound in (1 << 20, 0):
        out = D.benchmark_hits(docs, bench, keep_cols=["doc_id"], max_index_bytes=bound).collect()
        assert len(out) == len(TEXTS)
        for r in out:
            assert tuple(r["_hits"]) == expected(TEXTS[r["doc_id"]]), (bound, r["doc_id"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM, "", ""), (1, ITEM, "", "")], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert D.benchmark_hits(docs, none, keep_cols=["doc_id"]).filter("_hits.contaminated").count() == 0
    assert D.benchmark_hits(docs.limit(0), spark.createDataFrame(BENCH, ITEMS)).count() == 0


def test_spans_and_their_removal_on_both_paths(spark):
    texts = {
        1: "pre " + ITEM.replace("quick", "QUICK") + ", post", 2: "clean text", 3: None, 4: "", 5: "x SHORT-item y; short item", 6: "a short short item item b",
        7: "été, " + ITEM + "! Ünd", 8: "short item",
    }
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts.items()], "doc_id bigint, text string, _spans string, _n_removed string")
    bench = spark.createDataFrame(BENCH, ITEMS)
    n = len(tokens(ITEM))
    for bound in (1 << 20, 0):
        out = {r["doc_id"]: r["_spans"].asDict(recursive=True) for r in D.benchmark_spans(docs, bench, keep_cols=["doc_id"], max_index_bytes=bound).collect()}
        ranges = {i: [(s["start"], s["end"]) for s in x["spans"]] for i, x in out.items()}
        assert ranges == {1: [(1, 1 + n)], 2: [], 3: [], 4: [], 5: [(1, 3), (4, 6)], 6: [(2, 4)], 7: [(1, 1 + n)], 8: [(0, 2)]}, bound
        assert {i: x["items"] for i, x in out.items()} == {1: ["7"], 2: [], 3: [], 4: [], 5: ["10", "11"], 6: ["10", "11"], 7: ["7"], 8: ["10", "11"]}
        cut = D.remove_benchmark_spans(docs, bench, max_index_bytes=bound)
        assert cut.columns == [*docs.columns, "_n_removed_"]
        got = {r["doc_id"]: (r["text"], r["_n_removed_"]) for r in cut.collect()}
        assert got == {1: ("pre , post", n), 2: ("clean text", 0), 3: (None, 0), 4: ("", 0), 5: ("x  y; ", 4), 6: ("a  b", 4), 7: ("été, ! Ünd", n), 8: ("", 2)}, bound
        assert D.benchmark_hits(cut, bench, max_index_bytes=bound).filter("_hits.contaminated").isEmpty()

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.llm import quality_rules as Q

SCHEMA = "doc_id bigint, text string, _F string, lang string"
TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e " * 6, "x y z\nx y z\n\n \nq\nx y z", "été déjà 😀 # $ & | < > % *", " non breaking space",
    "a a a a a a a a a a a", "p q r s t u p q r s t v p q r s t", "w " * 30_000, "The quick of and the to be. " * 3, "tail \x0b\x0c\r\n head",
    "the cat of the house and a dog in that is for " + " ".join(f"word{i}" for i in range(80)),
]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "extra", None) for i, t in enumerate(TEXTS)], SCHEMA)
    for r in Q.quality_rules(df, keep_cols=["doc_id"]).collect():
        f = r["_f"]
        want = counts(TEXTS[r["doc_id"]])
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_documents_match_brute_force(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = Q.op9(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(texts[r["doc_id"]])


def test_time_grows_with_the_text(spark):
    seconds = []
    for n in (1000, 50_000, 100_000, 200_000):
        text = " ".join(f"w{i * 7919 % (n // 2)}" for i in range(n)) + "\n" + "x y z\n" * (n // 10)
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        began = time.perf_counter()
        row = Q.with_features(df, F.col("text")).select("_f.*").first()
        seconds.append(time.perf_counter() - began)
        if n == 1000:
            assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == counts(text)
    assert seconds[2] < 2.5 * seconds[1] + 0.7 and seconds[3] < 2.5 * seconds[2] + 0.7, seconds


def test_empty_table_and_repeated_rows(spark):
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "same text", None, None)] * 3, SCHEMA)
    assert Q.quality_rules(df).count() == 3


def test_estimate_recovers_accuracies():
    import random

    rng, right, patterns = random.Random(5), [0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.95, 0.9, 0.8], Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        patterns[tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < p) == good else -1) for p in right)] += 1
    model = Q.estimate(sorted(patterns.items()))
    assert model.prior == pytest.approx(0.7, abs=0.04)
    assert model.right_good == pytest.approx(right, abs=0.06)


def judged(votes, model, threshold=0.5):
    """The verdict written out from the model's numbers."""
    odds = model.prior / (1 - model.prior)
    for v, g, b in zip(votes, model.right_good, model.right_bad):
        odds *= g / (1 - b) if v == 1 else (1 - g) / b if v == -1 else 1
    return odds / (1 + odds)


def rule_votes(text):
    """The nine rules by hand."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, chars, symbols, copies, repeats = counts(text)
    joined = "".join(words)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    stops, capitals, exclaims = len(set(words) & set(Q.STOP_WORDS)), sum("A" <= c <= "Z" for c in joined), joined.count("!")
    of = lambda a, b: a / max(b, 1)
    pairs = [
        (n < 10, n >= 50), (of(symbols_in(joined), n) > 0.2, n >= 10 and of(symbols_in(joined), n) <= 0.02), (of(symbols, chars) > 0.04, n >= 10 and of(symbols, chars) <= 0.004),
        (lines >= 6 and of(copies, lines) > 0.3, lines >= 3 and copies == 0), (of(repeats, n) > 0.2, n >= 30 and of(repeats, n) <= 0.02),
        (not 2.5 <= of(chars, n) <= 12, 3 <= of(chars, n) <= 9), (n >= 60 and stops == 0, stops >= 3), (of(capitals, chars) > 0.3, chars >= 40 and of(capitals, chars) < 0.1), (of(exclaims, n) > 0.3, n >= 30 and of(exclaims, n) < 0.05),
    ]
    return tuple(-1 if bad else 1 if good else 0 for bad, good in pairs)


def symbols_in(joined):
    return len(re.findall(r"[#*$%&|<>]", joined))


def maximised(patterns, rounds=200, strength=0.02, held=(0.97, 0.3, 0.9)):
    """Expectation-maximisation pattern by pattern."""
    k, total = len(Q.RULES), sum(c for _, c in patterns)
    p, s = [0.05 if -1 in v else 0.95 if 1 in v else 0.5 for v, _ in patterns], strength * max(1, total)
    for _ in range(rounds):
        good, bad = [], []
        for r in range(k):
            g, b = [(w * c, v[r]) for (v, c), w in zip(patterns, p) if v[r]], [((1 - w) * c, v[r]) for (v, c), w in zip(patterns, p) if v[r]]
            good.append(min(max((s * held[0] + sum(w for w, x in g if x == 1)) / (s + sum(w for w, _ in g)), 0.5), 0.9995))
            bad.append(min(max((s * held[1] + sum(w for w, x in b if x == -1)) / (s + sum(w for w, _ in b)), 1 - good[-1] + 1e-6), 0.9995))
        base = min(max((s * held[2] + sum(w * c for (_, c), w in zip(patterns, p))) / (s + total), 0.05), 0.995)
        model = Q.RuleModel(base, tuple(good), tuple(bad))
        p = [judged(v, model) for v, _ in patterns]
    return model


def test_verdicts_match_brute_force(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        votes = {k: rule_votes(t) for k, t in texts.items()}
        model = maximised(sorted(Counter(votes.values()).items()))
        got = Q.op9(spark, d).collect()
        assert len(got) == len(texts)
        for r in got:
            p = judged(votes[r["doc_id"]], model)
            assert r["p_good"] == pytest.approx(p, abs=1e-4) and r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    both = Q.op9(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in both}
    assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, False), 0) + n.get((0, True), 0))

"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good, votes bad or abstains on a document. Expectation-maximisation over the vote patterns estimates
how often each rule is right about good and about bad documents, and the posterior probability of "good" replaces a
conjunction of all rules. The patterns are counted on the executors; with R rules there are at most 3**R of them, so
what the driver holds does not grow with the corpus.

Defined cases: null and blank texts have no words, every count 0, and fail the base; ties, repeated rows and clashing
column names change nothing, as each row is judged alone from its text and the shared model; an empty table gives an
empty result (the model is then its prior).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import documents, free_names, materialize, named, words

#: Frequent function words of the supported languages: prose has several of them.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "le", "et", "les", "des", "en", "un", "que", "el", "y", "los", "der", "die", "und", "das", "ist", "nicht", "ein")
SYMBOLS = r"[^#*$%&|<>]+"
GOOD, BAD, ABSTAIN = 1, -1, 0


def _f(name: str) -> Column:
    return F.col(f"_f.{name}")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), BAD).when(F.coalesce(good, F.lit(False)), GOOD).otherwise(ABSTAIN).cast("tinyint")


def _share(part: str, of: str) -> Column:
    return _f(part) / F.greatest(_f(of), F.lit(1))


#: Rule name -> (votes bad if, votes good if).
RULES = {
    "length": lambda: (_f("n_words") < 10, _f("n_words") >= 50),
    "symbols": lambda: (_share("n_symbols", "n_words") > 0.2, (_f("n_words") >= 10) & (_share("n_symbols", "n_words") <= 0.02)),
    "symbol_density": lambda: (_share("n_symbols", "word_chars") > 0.04, (_f("n_words") >= 10) & (_share("n_symbols", "word_chars") <= 0.004)),
    "line_copies": lambda: ((_f("n_lines") >= 6) & (_share("n_dup_lines", "n_lines") > 0.3), (_f("n_lines") >= 3) & (_f("n_dup_lines") == 0)),
    "repeats": lambda: (_share("n_repeat_words", "n_words") > 0.2, (_f("n_words") >= 30) & (_share("n_repeat_words", "n_words") <= 0.02)),
    "word_length": lambda: ((_share("word_chars", "n_words") < 2.5) | (_share("word_chars", "n_words") > 12), _share("word_chars", "n_words").between(3.0, 9.0)),
    "stop_words": lambda: ((_f("n_words") >= 60) & (_f("n_stops") == 0), _f("n_stops") >= 3),
    "capitals": lambda: (_share("n_capitals", "word_chars") > 0.3, (_f("word_chars") >= 40) & (_share("n_capitals", "word_chars") < 0.1)),
    "shouting": lambda: (_share("n_exclaims", "n_words") > 0.3, (_f("n_words") >= 30) & (_share("n_exclaims", "n_words") < 0.05)),
}


def with_features(df: DataFrame, text: Column) -> DataFrame:
    """df with a struct column _f of counts over the whole text.

    Windows are compared by a 64-bit hash of their five words within one text.
    """
    lines = F.split(F.col("_t"), "\n")
    h, s, d = F.col("_h"), F.col("_s"), F.col("_d")
    w = F.col("_w")
    df = df.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_w", words(F.col("_t")))
    df = df.withColumns({
        "_h": F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")),
        "_l": F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_j": F.array_join(w, ""),
    })
    df = df.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    same = lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
    df = df.withColumn("_d", F.sort_array(F.transform(F.filter(s, same), lambda e: e["p"])))
    covered = F.aggregate(F.transform(d, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(d, j + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length("_j"),
        "n_symbols": F.length(F.regexp_replace("_j", SYMBOLS, "")),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
        "n_stops": F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))),
        "n_capitals": F.length(F.regexp_replace("_j", r"[^A-Z]+", "")),
        "n_exclaims": F.length(F.regexp_replace("_j", r"[^!]+", "")),
    }
    return df.withColumn("_f", F.struct(*[c.cast("bigint").alias(k) for k, c in counts.items()])).drop("_t", "_w", "_h", "_l", "_j", "_s", "_d")


@dataclass(frozen=True)
class RuleModel:
    """P(good), and for each rule P(votes good | good, votes) and P(votes bad | bad, votes)."""

    prior: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def log_odds(self, votes: Column) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, g, b in zip(RULES, self.right_good, self.right_bad, strict=True):
            total = total + F.when(votes[name] == GOOD, math.log(g / (1 - b))).when(votes[name] == BAD, math.log((1 - g) / b)).otherwise(0.0)
        return total


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, strength: float = 0.02, held: tuple[float, float, float] = (0.97, 0.3, 0.9)) -> RuleModel:
    """Expectation-maximisation from vote patterns and their counts.

    held: what is believed of P(votes good | good), P(votes bad | bad) and P(good) before data, worth `strength` votes a document.
    A rule that looks for one defect passes bad documents with other defects, hence the second, low value. The first
    guess takes a document for bad if any rule votes so. A vote is never allowed to count against its own meaning.
    """
    votes = np.array([v for v, _ in patterns], dtype=np.int8).reshape(-1, len(RULES))
    count = np.array([c for _, c in patterns], dtype=float)
    says_good, says_bad = votes == GOOD, votes == BAD
    said = (says_good | says_bad).astype(float)
    p = np.where(says_bad.any(axis=1), 0.05, np.where(says_good.any(axis=1), 0.95, 0.5))
    strength *= max(1.0, count.sum())
    then = np.zeros(0)
    for _ in range(rounds):
        weight_good, weight_bad = p * count, (1 - p) * count
        good = np.clip((strength * held[0] + weight_good @ says_good) / (strength + weight_good @ said), 0.5, 0.9995)
        bad = np.clip((strength * held[1] + weight_bad @ says_bad) / (strength + weight_bad @ said), 1 - good + 1e-6, 0.9995)
        base = float(np.clip((strength * held[2] + weight_good.sum()) / (strength + count.sum()), 0.05, 0.995))
        now = np.array([*good, *bad, base])
        if len(then) and np.abs(now - then).max() < 1e-9:
            break
        then = now
        odds = math.log(base / (1 - base)) + says_good @ np.log(good / (1 - bad)) + says_bad @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    good, bad = good.tolist(), bad.tolist()
    return RuleModel(base, tuple(good), tuple(bad))


def quality_rules(df: DataFrame, text_col: str = "text", keep_cols: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of df: keep_cols (default: all), the struct _f of counts, base_failed, p_good and kept.

    The counted rows are written once to the shared folder, so the texts are read once for both the estimate and the
    verdict. With the text among keep_cols it is written along. A result whose name is taken by a kept column gets an
    underscore after it; results come last, in this order.
    """
    cols = keep_cols if keep_cols is not None else df.columns
    plain = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)], named(text_col).alias("_text"))
    votes = F.struct(*[_vote(*rule()).alias(k) for k, rule in RULES.items()])
    counted = with_features(plain, F.col("_text")).drop("_text").withColumn("_v", votes)
    counted = materialize(counted, "rules")
    grouped = counted.groupBy("_v").count().collect()  # at most 3 ** len(RULES) rows
    model = estimate(sorted((tuple(r["_v"]), r["count"]) for r in grouped))
    failed = _base_failed()
    p_good = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.log_odds(F.col("_v"))))
    out = counted.withColumn("_p", p_good)
    results = (F.col("_f"), failed, F.col("_p"), ~failed & (F.col("_p") >= threshold))
    names = free_names(cols, "_f", "base_failed", "p_good", "kept")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], *[r.alias(n) for r, n in zip(results, names, strict=True)])


def _base_failed() -> Column:
    return (_f("n_words") < 10) | (F.lit(100) * _f("n_repeat_words") > F.lit(20) * _f("n_words"))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(spark, sf_dir: str) -> DataFrame:
    """What op9 counts before any rule votes."""
    docs = documents(spark, sf_dir)
    return with_features(docs.select("doc_id", "text"), F.col("text")).select("doc_id", *[_f(k).alias(k) for k in BASE], _base_failed().alias("base_failed"))


#: SQL for the counts; the verdict needs the estimate, which SQL can't make.
BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed
FROM c LEFT JOIN hit USING (doc_id)
"""


def op9(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), keep_cols=["doc_id"])
    return out.select("doc_id", *[_f(k).alias(k) for k in BASE], "base_failed", "kept", F.round("p_good", 6).alias("p_good"))

"""Graded quality by ordinal cumulative-link regression over hashed text.

One weight vector w is shared by all grades; ordered thresholds t give P(grade <= k) = logistic(t[k] - w.x). Features
are presences: hashed lower-cased whole words, beside them the stems of 4 and 5 letters of longer ones, shapes of runs of
other marks (which characters, and how many in powers of two), and bands of repetition and length. The expected grade
orders documents, the tail probability P(grade >= keep_grade) selects them.

The grades of `documents` come from `labels`: 0 for toxic, 1 for low quality, 2 for neither.

The fit runs on the driver over a sample of rated rows, drawn by a hash of the id so that about `sample` rows come
(a documented bound), and keeps weights for at most `most_features` of them, the most telling (a bound on the model, 4,096
by default; it says nothing about what is scored). Scoring reads whole texts.

Defined cases: a null text is empty; an empty text is scored from its bands alone; rows without a grade teach nothing;
with no rated rows every grade is equally likely; repeated rows get equal scores; an empty table is empty.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.shared import chunks, documents, free_names, named

HASH_BITS = 24
#: Letters make words, other visible characters make marks.
WORDS, MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"[^\w\s]+")
RESULT = "expected_grade double, tail_prob double, kept boolean"


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


def features(text: str) -> set[str]:
    found = WORDS.findall(text)
    lower = [w.lower() for w in found]
    pairs = len(set(zip(lower, lower[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    capitals = sum(w.isupper() and len(w) > 1 for w in found)
    bands = {
        f"\x01pairs{min(10, 10 * pairs // max(1, len(lower) - 1))}", f"\x01lines{10 * len(set(lines)) // max(1, len(lines))}",
        f"\x01capitals{10 * capitals // max(1, len(found))}", f"\x01size{len(lower).bit_length()}",
    }
    distinct = set(lower)
    starts = {f"\x03{w[:n]}" for w in distinct for n in (4, 5) if len(w) > n}
    shapes = {f"\x02{''.join(dict.fromkeys(m))}{len(m).bit_length()}" for m in set(MARKS.findall(text))}
    return distinct | starts | shapes | bands


class Model:
    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_most(self, text: str | None) -> np.ndarray:
        get = self.weights.get
        x = sum(get(_bucket(f), 0.0) for f in features(text or ""))
        return 1 / (1 + np.exp(-np.clip(self.thresholds - x, -50, 50)))

    def predict(self, text: str | None, keep_grade: int, least: float) -> tuple[float, float, bool]:
        below = self.at_most(text)
        tail = float(1 - below[keep_grade - 1])
        return float(len(below) - below.sum()), tail, tail >= least


def fit(rows: list[tuple[int, np.ndarray]], grades: int, least: int = 10, most_features: int = 4096, rounds: int = 400, sparsity: float = 3e-4) -> Model:
    """Maximum likelihood less `sparsity` times the sum of absolute weights, by adaptive full-batch steps.

    Of the features that `least` documents have, the `most_features` whose presence departs most from the grades' shares
    are used (by a squared standard score, at least 12). Thresholds stay ordered as sums of exponentials.
    """
    if not rows:
        return Model({}, np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    y = np.array([g for g, _ in rows])
    flat = np.concatenate([f for _, f in rows])
    doc = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    ids, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    by_grade = np.bincount(column * grades + y[doc], minlength=len(ids) * grades).reshape(-1, grades)
    rate = np.bincount(y, minlength=grades) / len(y)
    apart = ((by_grade - n[:, None] * rate) ** 2 / np.maximum(n[:, None] * rate * (1 - rate), 1e-9)).max(axis=1)
    telling = apart * (n >= least) * (apart >= 12)
    telling[np.argsort(-telling, kind="stable")[most_features:]] = 0
    used = telling[column] > 0
    kept, column = np.unique(column[used], return_inverse=True)
    doc = doc[used]
    w = np.zeros(len(kept))
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / len(y), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    free = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    sw, sf = np.full_like(w, 1e-8), np.full_like(free, 1e-8)
    for _ in range(rounds):
        t = np.concatenate([free[:1], free[:1] + np.cumsum(np.exp(free[1:]))])
        x = np.bincount(doc, w[column], minlength=len(rows))
        c = 1 / (1 + np.exp(-np.clip(t[None, :] - x[:, None], -50, 50)))
        c = np.concatenate([np.zeros((len(y), 1)), c, np.ones((len(y), 1))], axis=1)
        at = np.arange(len(y))
        hi, lo = c[at, y + 1], c[at, y]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p / len(y), lo * (1 - lo) / p / len(y)
        gw = np.bincount(column, (d_hi - d_lo)[doc], minlength=len(w))
        gt = np.array([d_lo[y == k + 1].sum() - d_hi[y == k].sum() for k in range(grades - 1)])
        steps = np.exp(free[1:])
        gf = np.concatenate([[gt.sum()], steps * np.cumsum(gt[::-1])[::-1][1:]])
        sw, sf = sw + gw ** 2, sf + gf ** 2
        step = 0.3 / np.sqrt(sw)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparsity, 0.0)
        free -= 0.1 * gf / np.sqrt(sf)
    t = np.concatenate([free[:1], free[:1] + np.cumsum(np.exp(free[1:]))])
    return Model({int(i): float(v) for i, v in zip(ids[kept], w, strict=True) if abs(v) > 1e-4}, t)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(rated: DataFrame, grades: int, text_col: str = "text", grade_col: str = "grade", id_col: str = "doc_id", sample: int = 8000) -> Model:
    """Fit on the rows of rated that are not held out and have an id and a grade from 0 to grades - 1."""
    plain = rated.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("_text"), named(grade_col).cast("int").alias("grade")).filter(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1)).filter(~held_out(F.col("id")))
    total = plain.count()
    drawn = plain.filter(F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1_000_003)) < int(min(1.0, sample / max(total, 1)) * 1_000_003))

    def extract(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                found = [np.unique(np.fromiter(map(_bucket, features(t.as_py())), dtype=np.int32)) for t in part.column("_text")]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("grade"), pa.array(found, pa.list_(pa.int32()))], names=["id", "grade", "buckets"])

    table = drawn.mapInArrow(extract, "id string, grade int, buckets array<int>").toArrow()
    order = sorted(zip(table.column("id").to_pylist(), table.column("grade").to_pylist(), range(table.num_rows), strict=True))
    buckets = table.column("buckets")
    return fit([(g, buckets[i].values.to_numpy()) for _, g, i in order], grades)


def classify(df: DataFrame, model: Model, keep_grade: int, least: float = 0.4, text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """keep_cols (default: all) and the struct _quality: expected grade, P(grade >= keep_grade), whether that is at least `least`."""
    cols = keep_cols if keep_cols is not None else df.columns
    plain = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)], named(text_col).alias("_text"))
    shipped = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    struct = pa.struct([("expected_grade", pa.float64()), ("tail_prob", pa.float64()), ("kept", pa.bool_())])

    def score(batches):
        for batch in batches:
            found = [dict(zip(("expected_grade", "tail_prob", "kept"), shipped.value.predict(t.as_py(), keep_grade, least), strict=True)) for t in batch.column("_text")]
            yield batch.select([c for c in batch.schema.names if c != "_text"]).append_column("_quality", pa.array(found, type=struct))

    out = plain.mapInArrow(score, T.StructType([*plain.drop("_text").schema, T.StructField("_quality", T.StructType.fromDDL(RESULT))]))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], F.col("_quality").alias(*free_names(cols, "_quality")))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return docs.select("doc_id", "text").join(labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade")), "doc_id")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(graded(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), grades=3)
    out = classify(docs, model, keep_grade=2, keep_cols=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_quality.*")

"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed character n-grams predicts each bit of it. Decoding
weighs the loss of each bit by how reliable its classifier was in training, takes the nearest codeword and flags a
document as ambiguous when the second nearest is close.

The classifiers are fitted on the driver from at most about `sample_per_lang` rows of each language (a documented
bound: rows are drawn by a hash of their id, at a rate set from the language's row count). Scoring reads whole texts.

Defined cases: a null text, or one without a letter, is "und" with score 0, as is everything when nothing could be
learned; rows with a null language or id teach nothing; with one language learned, that one is predicted; a null id is
not held out; repeated rows get equal predictions.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import chunks, documents, free_names, named

BUCKET_BITS = 14
#: Rows that are dense at a time in training (32 MB), and how many such blocks stay in memory, however many languages there are.
BLOCK, KEPT_BLOCKS = 512, 4
#: Odd multipliers, one for each position in an n-gram, and one that separates the lengths.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
RESULT = "lang_pred string, score double, ambiguous boolean"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """Buckets of all 1- to 3-grams of the lower-cased text, every non-letter a space; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, dtype=np.int64)
    points = np.where(is_letter, points, 32).astype(np.uint64)
    out, total = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(min(3, len(points))):
        total = total[:len(points) - n] + (points[n:] + np.uint64(n)) * MULTIPLIERS[n]
        mixed = (total ^ (total >> np.uint64(31))) * MULTIPLIERS[0]
        out.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Up to 5 languages: all 2**(k-1) - 1 splits. Beyond: of many drawn balanced codes, the one whose nearest rows are farthest apart."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        splits = [[1 if i == 0 or s >> (i - 1) & 1 else -1 for i in range(k)] for s in range(2 ** (k - 1) - 1)]
        return np.array(splits, dtype=float).T
    rng, best, far = np.random.default_rng(7), None, -1.0
    for _ in range(300):
        code = np.sign(rng.permuted(np.tile(np.linspace(-1, 1, k)[:, None], 6 * math.ceil(math.log2(k))), axis=0) + 1e-9)
        apart = (code.shape[1] - code @ code.T)[~np.eye(k, dtype=bool)].min()
        if apart > far:
            best, far = code, apart
    return best


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.weights, self.bias, self.trust = langs, weights, bias, trust
        self.code = codewords(len(langs))

    def predict(self, text: str | None, margin: float = 0.2) -> tuple[str, float, bool]:
        found = grams(text) if text else ()
        if not self.langs or not len(found):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        bits = self.bias + np.array([np.take(w, found).mean() for w in self.weights])
        loss = (np.logaddexp(0.0, -self.code * bits) * self.trust).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, second = np.sort(p)[::-1][:2]
        return self.langs[int(loss.argmin())], float(min(1.0, first)), bool(first - second < margin)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 150) -> Model:
    """From (language, buckets, counts) rows: logistic regression for each bit on relative frequencies, languages weighted equally."""
    langs = sorted({r[0] for r in rows})
    if len(langs) < 2:
        return Model(langs, np.zeros((0, 1)), np.zeros(0), np.zeros(0))
    cuts = range(0, len(rows), BLOCK)

    def dense(at: int) -> np.ndarray:
        part = rows[at:at + BLOCK]
        x = np.zeros((len(part), 1 << BUCKET_BITS), dtype=np.float32)
        for i, (_, buckets, counts) in enumerate(part):
            x[i, buckets] = counts / counts.sum()
        return x * scale

    scale = np.float32(1)
    scale = (1 / np.sqrt(sum((dense(at) ** 2).sum(axis=0) for at in cuts) / len(rows) + 1e-8)).astype(np.float32)
    kept = {at: dense(at) for at in cuts[:KEPT_BLOCKS]}  # the others are made anew in each round
    blocks = lambda: ((slice(at, at + BLOCK), kept[at] if at in kept else dense(at)) for at in cuts)
    who = np.array([langs.index(r[0]) for r in rows])
    y = codewords(len(langs))[who].astype(np.float32)
    share = (1 / np.bincount(who)[who] / len(langs)).astype(np.float32)[:, None]
    n = sum(float(np.abs(x).sum()) for _, x in blocks()) / len(rows)
    w, b = np.zeros((1 << BUCKET_BITS, y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    sw, sb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(rounds):
        gw, gb = 1e-5 * w, np.zeros_like(b)
        for at, x in blocks():
            f = x @ w + b
            g = -y[at] / (1 + np.exp(np.clip(y[at] * f, -30, 30))) * share[at]
            gw, gb = gw + x.T @ g, gb + g.sum(axis=0)
        sw, sb = sw + gw ** 2, sb + gb ** 2
        w -= 5 / n * gw / np.sqrt(sw)
        b -= 0.1 * gb / np.sqrt(sb)
    wrong = sum((((x @ w + b) * y[at] <= 0) * share[at]).sum(axis=0) for at, x in blocks())
    trust = np.log((1 - wrong + 1e-3) / (wrong + 1e-3))
    return Model(langs, np.ascontiguousarray((w * scale[:, None]).T), b, np.maximum(trust, 0.0) / max(trust.max(), 1e-9))


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 250) -> Model:
    """Fit on rows that are not held out and have a language."""
    plain = df.select(named(id_col).alias("id"), named(text_col).alias("_text"), named(lang_col).alias("lang")).filter("id IS NOT NULL AND lang IS NOT NULL AND _text IS NOT NULL").filter(~held_out(F.col("id")))
    counts = {r["lang"]: r["count"] for r in plain.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return fit([])
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_per_lang / n))])[F.col("lang")]
    drawn = plain.filter(F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1_000_003)) < rate * 1_000_003)

    def count(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                ids, langs, texts = (part.column(c).to_pylist() for c in ("id", "lang", "_text"))
                found = [np.unique(grams(t), return_counts=True) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array(langs, pa.string()), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))], names=["id", "lang", "buckets", "counts"])

    table = drawn.mapInArrow(count, "id string, lang string, buckets array<int>, counts array<int>").toArrow()
    order = sorted(zip(table.column("id").to_pylist(), table.column("lang").to_pylist(), range(table.num_rows), strict=True))
    buckets, counted = table.column("buckets"), table.column("counts")
    sparse = [(lang, buckets[i].values.to_numpy(), counted[i].values.to_numpy()) for _, lang, i in order]
    return fit([r for r in sparse if len(r[1])])


def predict(df: DataFrame, model: Model, text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """keep_cols (default: all) and the struct _language of prediction, score and ambiguity; the text alone is read for it."""
    from pyspark.sql import types as T

    cols = keep_cols if keep_cols is not None else df.columns
    plain = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)], named(text_col).alias("_text"))
    shipped = df.sparkSession.sparkContext.broadcast(model)  # languages x bits x 2**BUCKET_BITS numbers, whatever the corpus
    struct = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def score(batches):
        for batch in batches:
            found = [dict(zip(("lang_pred", "score", "ambiguous"), shipped.value.predict(t.as_py()), strict=True)) for t in batch.column("_text")]
            yield batch.select([c for c in batch.schema.names if c != "_text"]).append_column("_language", pa.array(found, type=struct))

    out = plain.mapInArrow(score, T.StructType([*plain.drop("_text").schema, T.StructField("_language", T.StructType.fromDDL(RESULT))]))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], F.col("_language").alias(*free_names(cols, "_language")))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs), keep_cols=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_language.*")

"""Benchmark decontamination: token windows of the corpus against the windows of the test items.

The windows of all items form one hash set that every executor holds; a window of a document that hits it is verified
word by word. The set is broadcast only while the items stay under `max_index_bytes`; beyond that the windows of both
sides are joined in a shuffle instead (`joined_spans`), with the same result.

What is found are ranges of words and the items they hit (`benchmark_spans`); `benchmark_hits` derives digests of them, and
`remove_benchmark_spans` cuts the ranges out of the texts.

Defined cases: a null or wordless text has no words, no hits and is clean; a wordless item matches nothing; an item of
fewer words than a window is one window; items with the same id count once; windows of an item without an id mark
words but add no item; repeated rows are judged each on its own; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.offsets import running
from veilframe.functions.validators import let
from veilframe.llm.shared import chunks, documents, free_names, materialize, named

#: Bytes of words: digits, letters (to lower case) and everything outside ASCII; the rest separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text of the items up to which their windows are broadcast; README says how much memory that takes.
MAX_INDEX_BYTES = 16 << 20
SPANS = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
_WORD = re.compile(rb"[^ ]+")


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class WindowSet:
    """The distinct windows of the items, by length: their keys in order, where the words of each stand, and the items that hold it.

    Words are numbered; windows are kept as places in the items' words, some 20 bytes a word of the benchmark in all.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], width: int = 10):
        self.vocabulary: dict[bytes, int] = {}
        lists = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(t)), dtype=np.int32) for _, t in items]
        self.flat = np.concatenate([np.zeros(0, np.int32), *lists])
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(self.names)}
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        firsts = np.cumsum(sizes) - sizes
        who = np.array([-1 if i is None else number[str(i)] for i, _ in items], dtype=np.int32)
        self.tables = [self._table(n, firsts, sizes, who, width) for n in np.unique(np.minimum(sizes, width)).tolist() if n]

    def _table(self, n: int, firsts: np.ndarray, sizes: np.ndarray, who: np.ndarray, width: int) -> tuple:
        of = np.flatnonzero(sizes >= n if n == width else sizes == n)
        many = sizes[of] - n + 1
        item = np.repeat(who[of], many)
        place = np.repeat(firsts[of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        multiplier = 0x9E3779B97F4A7C15
        while True:
            keys = self.keys(self.flat, place, n, multiplier)
            order = np.lexsort((item, keys))
            keys, by, at = keys[order], item[order], place[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            if all(np.array_equal(self.flat[at + k], self.flat[first + k]) for k in range(n)):
                break  # else two different windows have one key
            multiplier += 2
        cuts = np.flatnonzero(new)
        single = (by >= 0) & (new | np.concatenate([[True], by[1:] != by[:-1]]))
        held = np.concatenate([[0], np.cumsum(single)])[np.append(cuts, len(keys))]
        return n, multiplier, keys[cuts], at[cuts], held, by[single]

    @staticmethod
    def keys(words: np.ndarray, at: np.ndarray, n: int, multiplier: int) -> np.ndarray:
        """Of the n words from each place."""
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            out = (out ^ words[at + k].astype(np.uint64)) * np.uint64(multiplier)
            out ^= out >> np.uint64(29)
        return out

    def scan(self, texts: list[bytes | None]):
        """Per text: number of words, mask of hit words, ids of the items found."""
        lists = [tokens(t) for t in texts]
        flat: list = []
        for x in lists:
            flat += x
            flat.append(None)  # no window crosses it
        ids = np.fromiter(map(self.vocabulary.get, flat, repeat(0)), dtype=np.int32, count=len(flat))
        ends = np.cumsum([len(x) + 1 for x in lists])
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        hit, found = np.zeros(len(ids) + 1, dtype=np.int64), [set() for _ in lists]
        for n, multiplier, keys, places, held, by in self.tables:
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            found_at = np.minimum(np.searchsorted(keys, k := self.keys(ids, at, n, multiplier)), len(keys) - 1)
            true = keys[found_at] == k
            at, found_at = at[true], found_at[true]
            true = np.ones(len(at), dtype=bool)
            for k in range(n):
                true &= self.flat[places[found_at] + k] == ids[at + k]
            at, found_at = at[true], found_at[true]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
            for d, p in zip(np.searchsorted(ends, at, side="right").tolist(), found_at.tolist(), strict=True):
                found[d].update(by[held[p]:held[p + 1]].tolist())
        covered = np.cumsum(hit)[:-1] > 0
        return [(len(x), covered[e - len(x) - 1:e - 1], sorted(self.names[i] for i in f)) for x, e, f in zip(lists, ends.tolist(), found, strict=True)]


def joined_spans(plain: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """The same spans by a shuffle join of windows, for benchmarks too large to broadcast. plain has _text; items _item and _text.

    Of the corpus' windows only place and hash travel; what meets a window of an item comes back to its row, and counts
    if the words are the same.
    """
    lower = F.translate(F.coalesce(F.col("_text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = items.select("_item", listed.alias("_w")).filter(F.size("_w") > 0).withColumn("_n", F.least(F.size("_w"), F.lit(width)))
    window = lambda i: F.array_join(F.slice("_w", i + 1, F.col("_n")), " ")
    items = items.select("_n", "_item", F.explode(F.transform(F.sequence(F.lit(0), F.size("_w") - F.col("_n")), window)).alias("_k")).distinct()
    items = materialize(items.withColumn("_h", F.xxhash64("_k")), "items")
    sizes = F.broadcast(items.select("_n").distinct())  # at most `width` rows
    rows = materialize(plain.withColumn("_id", F.monotonically_increasing_id()).withColumn("_w", listed).drop("_text"), "windows")
    each = rows.select("_id", "_w").join(sizes, F.size("_w") >= F.col("_n"))
    each = each.select("_id", "_n", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_w") - F.col("_n")), lambda i: F.xxhash64(window(i)))).alias("_p", "_h"))
    met = each.join(items.hint("merge"), ["_n", "_h"]).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_p", "_n", "_k", "_item"))).alias("_met"))
    true = F.filter(F.coalesce("_met", F.array().cast("array<struct<_p:int,_n:int,_k:string,_item:string>>")), lambda m: F.array_join(F.slice("_w", m["_p"] + 1, m["_n"]), " ") == m["_k"])
    out = rows.join(met, "_id", "left").withColumn("_met", true)

    def united(met: Column, upto: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(met) - 1), lambda i: (i == 0) | (F.get(met, i)["_p"] > F.get(upto, i - 1)))
        span = lambda of, i, k: F.struct(F.get(met, i)["_p"].cast("bigint").alias("start"), F.get(upto, F.coalesce(F.get(of, k + 1), F.size(met)) - 1).cast("bigint").alias("end"))
        return let(firsts, lambda of: F.transform(of, lambda i, k: span(of, i, k)))

    spans = let(F.col("_met"), lambda met: F.when(F.size(met) == 0, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(let(running(F.transform(met, lambda m: m["_p"] + m["_n"]), F.greatest), lambda upto: united(met, upto))))
    held = F.array_sort(F.array_distinct(F.filter(F.transform("_met", lambda m: m["_item"]), lambda i: i.isNotNull())))
    struct = F.struct(F.size("_w").cast("bigint").alias("n_words"), spans.alias("spans"), held.alias("items"))
    return out.select(*[c for c in plain.columns if c != "_text"], struct.alias("_spans"))


def benchmark_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_cols: list[str] | None = None, width: int = 10, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """One row per row of df: keep_cols (default: all) and the struct _spans: ranges of hit words, ids of the items found."""
    cols = keep_cols if keep_cols is not None else df.columns
    plain = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)], named(text_col).cast("binary").alias("_text"))
    items = benchmark.select(named(item_col).cast("string").alias("_item"), named(item_text_col).cast("binary").alias("_text"))
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if size > max_index_bytes:
        out = joined_spans(plain, items, width)
    else:
        index = WindowSet([(r["_item"], r["_text"]) for r in items.collect()], width)
        shipped = df.sparkSession.sparkContext.broadcast(index)
        struct = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

        def ranges(mask: np.ndarray) -> list[dict]:
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)) if mask.any() else mask[:0]
            return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]

        def scan(batches):
            for batch in batches:
                for part in chunks(batch, "_text", 2 << 20):
                    found = shipped.value.scan([x.as_py() for x in part.column("_text")])
                    spans = [{"n_words": n, "spans": ranges(mask), "items": i} for n, mask, i in found]
                    kept = part.select([c for c in part.schema.names if c != "_text"])
                    yield kept.append_column("_spans", pa.array(spans, type=struct))

        out = plain.mapInArrow(scan, plain.drop("_text").schema.add("_spans", T.StructType.fromDDL(SPANS)))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], F.col("_spans").alias(*free_names(cols, "_spans")))


def benchmark_hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_cols: list[str] | None = None, width: int = 10, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """One row per row of df: keep_cols (default: all) and the struct _hits, the digests of benchmark_spans."""
    cols = keep_cols if keep_cols is not None else df.columns
    found = benchmark_spans(df, benchmark, text_col, item_col, item_text_col, cols, width, max_index_bytes).toDF(*[f"_c{i}" for i in range(len(cols))], "_s")
    struct = F.struct(
        F.col("_s.n_words").alias("n_words"), _n_hit(F.col("_s.spans")).alias("n_hit"), F.size("_s.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_s.items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("_s.spans") > 0).alias("contaminated"),
    )
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], struct.alias(*free_names(cols, "_hits")))


def _n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])


def without(text: bytes, spans: list[dict]) -> bytes:
    """text less the bytes from the first to the last word of each span; what is around them stays as it is."""
    at, kept, done = [m.span() for m in _WORD.finditer(text.translate(WORD_BYTES))], [], 0
    for span in spans:
        kept.append(text[done:at[span["start"]][0]])
        done = at[span["end"] - 1][1]
    return b"".join([*kept, text[done:]])


def remove_benchmark_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """df with the hit words cut out of text_col, and _n_removed, how many went. No row goes.

    Words that meet at a cut can make a window anew, so texts that were cut are searched again until none has a hit.
    """
    cols = df.columns
    at, kind = f"_c{cols.index(text_col)}", df.schema[cols.index(text_col)].dataType
    rows = df.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(cols)], F.lit(0).cast("bigint").alias("_n"))
    rows, clean = rows.withColumn(at, F.col(at).cast("binary")), []

    def cut(batches):
        for batch in batches:
            texts = [without(t, s["spans"]) for t, s in zip(batch.column(at).to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index(at), at, pa.array(texts, pa.binary()))

    while True:
        found = materialize(benchmark_spans(rows, benchmark, at, item_col, item_text_col, None, width, max_index_bytes), "spans")
        clean.append(found.filter("size(_spans.spans) = 0").drop("_spans"))
        hit = found.filter("size(_spans.spans) > 0")
        if hit.isEmpty():
            break
        rows = hit.mapInArrow(cut, hit.schema).withColumn("_n", F.col("_n") + _n_hit(F.col("_spans.spans"))).drop("_spans")
    out = reduce(DataFrame.union, clean).withColumn(at, F.col(at).cast(kind))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], F.col("_n").alias(*free_names(cols, "_n_removed")))


def op3(spark, sf_dir: str) -> DataFrame:
    out = benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_cols=["doc_id"])
    return out.select("doc_id", "_hits.*")


_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

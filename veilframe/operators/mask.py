"""Masking: detected values give way to placeholders, with a report; and restoring: placeholders give way to values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.names import free_names
from veilframe.functions.offsets import find_all
from veilframe.functions.patterns import PLACEHOLDER
from veilframe.functions.validators import let
from veilframe.kinds import Settings
from veilframe.operators import mapping as M
from veilframe.operators.detect import detect, kind_name, kind_prefix

PLACEHOLDER_IN_TEXT = rf"(?U)\b{PLACEHOLDER}\b"
REPORT = "array<struct<placeholder:string,kind:string>>"


@dataclass
class Masked:
    """df: the input columns with masked, report, n_masked and summary; mapping: the table after minting; fresh: its new rows."""

    df: DataFrame
    mapping: DataFrame
    fresh: DataFrame
    cached: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Drop what was cached on the way; call it when the results have been written."""
        for df in self.cached:
            df.unpersist()


def splice(text: Column, pieces: Column) -> Column:
    """text with each [start, end) of pieces (ordered, not overlapping) replaced by its `put`.

    `substring` counts its way from the start, so each block of pieces is cut out of a stretch of its own.
    """
    ends = lambda p, i: F.coalesce(F.get(p, i)["end"], F.lit(0))

    def block(these: Column, first: Column) -> Column:
        part = F.substring(text, first + 1, F.element_at(these, -1)["end"] - first)
        put = lambda part: F.transform(these, lambda p, i: let(F.when(i == 0, first).otherwise(ends(these, i - 1)), lambda at: F.concat(F.substring(part, at - first + 1, p["start"] - at), p["put"])))
        return let(part, lambda part: F.array_join(put(part), ""))

    def whole(p: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(p))).cast("int")
        blocks = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.size(p) - 1, w), lambda i: let(F.slice(p, i + 1, w), lambda these: let(ends(p, i - 1), lambda first: block(these, first)))))
        return F.concat(F.array_join(blocks, ""), F.substring(text, ends(p, F.size(p) - 1) + 1, F.length(text)))

    return let(pieces, lambda p: F.when(F.size(p) == 0, text).otherwise(whole(p)))


def summary(report: Column) -> Column:
    """'2 EPOSTA, 1 TCKN': how many distinct placeholders of each kind, kinds in the order they were first seen."""
    kinds = F.transform(report, lambda r: r["kind"])
    prefix = F.create_map(*[F.lit(x) for k in M.KINDS for x in (k.name, k.prefix)])
    said = lambda k: F.concat_ws(" ", F.size(F.filter(kinds, lambda x: x == k)).cast("string"), prefix[k])
    return F.array_join(F.transform(F.array_distinct(kinds), said), ", ")


def _reported(pieces: Column) -> Column:
    """Distinct placeholders in first-seen order, each with the kind of its first match in this text."""
    by_name = F.array_sort(F.transform(pieces, lambda p: F.struct(p["put"].alias("put"), p["pos"].alias("pos"), p["kind"].alias("kind"))))
    first = lambda found: F.filter(found, lambda p, i: (i == 0) | (F.get(found, i - 1)["put"] != p["put"]))
    by_place = F.array_sort(F.transform(let(by_name, first), lambda p: F.struct(p["pos"].alias("pos"), p["put"].alias("put"), p["kind"].alias("kind"))))
    return F.transform(by_place, lambda p: F.struct(p["put"].alias("placeholder"), p["kind"].alias("kind")))


def _numbered(df: DataFrame, text_col: str, *others: str) -> tuple[DataFrame, list[str]]:
    """df with its columns under numbers, so that none clashes with a name used here: _c0, _c1, ...; and those of the named ones."""
    cols = df.columns
    return df.toDF(*[f"_c{i}" for i in range(len(cols))]), [f"_c{cols.index(c)}" for c in (text_col, *others)]


def _with_pieces(df: DataFrame, pieces: DataFrame, key: str, text: str) -> DataFrame:
    """df with what its rows found, by key and text."""
    same = df[key].eqNullSafe(pieces["_key"]) & (F.xxhash64(df[text]) == pieces["_hash"])
    return df.join(pieces, same, "left").drop("_key", "_hash")


def _renamed(out: DataFrame, cols: list[str], *results: str) -> DataFrame:
    """The columns under their own names again, then the results; one whose name is taken gets an underscore after it."""
    names = zip(results, free_names(cols, *results), strict=True)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], *[F.col(r).alias(n) for r, n in names])


def mask(df: DataFrame, text_col: str, key: str, order_col: str | None = None, settings: Settings | None = None, mapping: DataFrame | None = None) -> Masked:
    """Mask a column of texts. order_col (default: key) is the order in which values count as first seen.

    Only values travel: the new ones by value for their numbers, then each row's with its key. The last join is on the
    key and a hash of the text, nulls included, so that a missing or repeated key can neither leave a text unmasked nor
    mix two texts; rows that repeat another share its matches. All columns of df stay; a result whose name one of them
    has gets an underscore after it.
    """
    spark, cols = df.sparkSession, df.columns
    known = mapping if mapping is not None else M.empty_mapping(spark)
    df, (text, key, order) = _numbered(df, text_col, key, order_col or key)
    found = df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(order).alias("ord"), F.posexplode(detect(F.col(text), settings)).alias("pos", "m"))
    found = found.select("_key", "_hash", "ord", "pos", F.col("m.start").alias("start"), (F.col("m.start") - F.col("m.neg_length")).alias("end"), F.col("m.kind_ord").alias("kind_ord"), F.col("m.value").alias("value")).persist()
    cached = [found]
    fresh = M.mint(found, known, cached).persist()
    cached.append(fresh)
    total = M.remember(known, fresh)
    piece = F.struct("pos", "start", "end", kind_name(F.col("kind_ord")).alias("kind"), F.col("placeholder").alias("put"))
    # Only the older table can hold a value twice. The union is dealt out for the join like the matches are, so that
    # adaptive execution can split a value that is in a large share of them.
    placeholder = M.by_value(known).unionByName(fresh.select("value", "placeholder"))
    pieces = found.join(placeholder, "value").groupBy("_key", "_hash").agg(F.array_sort(F.collect_set(piece)).alias("_pieces"))
    out = _with_pieces(df, pieces, key, text)
    none = F.array().cast("array<struct<pos:int,start:int,end:int,kind:string,put:string>>")
    out = out.withColumn("_pieces", F.coalesce("_pieces", none))
    out = out.withColumn("masked", F.when(F.size("_pieces") == 0, F.col(text)).otherwise(splice(F.col(text), F.col("_pieces")))).withColumn("report", _reported(F.col("_pieces")))
    out = out.withColumn("n_masked", F.size("report")).withColumn("summary", summary(F.col("report")))
    return Masked(_renamed(out, cols, "masked", "report", "n_masked", "summary"), total, fresh, tuple(cached))


def placeholders(text: Column) -> Column:
    """Placeholders in a text with their places, known or not."""
    return find_all(text, PLACEHOLDER_IN_TEXT, -1)


def restore(df: DataFrame, text_col: str, key: str, mapping: DataFrame) -> DataFrame:
    """df with restored (known placeholders give way to their values) and n_restored, the number of places."""
    cols = df.columns
    df, (text, key) = _numbered(df, text_col, key)
    found = df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.posexplode(placeholders(F.col(text))).alias("pos", "m"))
    found = found.select("_key", "_hash", "pos", F.col("m.start").alias("start"), (F.col("m.start") - F.col("m.neg_length")).alias("end"), F.col("m.value").alias("placeholder"))
    piece = F.struct("pos", "start", "end", F.col("value").alias("put"))
    pieces = found.join(mapping.select("placeholder", "value"), "placeholder").groupBy("_key", "_hash").agg(F.array_sort(F.collect_set(piece)).alias("_pieces"))
    out = _with_pieces(df, pieces, key, text)
    count = F.when(F.col(text).isNotNull(), F.coalesce(F.size("_pieces"), F.lit(0)))
    out = out.withColumn("restored", F.when(F.col("_pieces").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_pieces")))).withColumn("n_restored", F.when(F.col("_pieces").isNull() & F.col(text).isNotNull(), 0).otherwise(count))
    return _renamed(out, cols, "restored", "n_restored")


def has_restorable(df: DataFrame, text_col: str, key: str, mapping: DataFrame) -> DataFrame:
    """df with restorable: whether a known placeholder is in the text."""
    cols = df.columns
    df, (text, key) = _numbered(df, text_col, key)
    found = df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER_IN_TEXT), F.lit(0)))).alias("placeholder"))
    hits = found.join(mapping.select("placeholder"), "placeholder", "left_semi").select("_key", "_hash").distinct().withColumn("restorable", F.lit(True))
    return _renamed(_with_pieces(df, hits, key, text).withColumn("restorable", F.coalesce("restorable", F.lit(False))), cols, "restorable")


def edit(text: Column, old: Column, new: Column) -> Column:
    """struct(status, occurrences, edited): exactly one occurrence of old is replaced; otherwise text stays and status says why. A null text or old has no occurrence."""
    count = F.when((old == "") | text.isNull() | old.isNull(), 0).otherwise(((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("int"))
    status = F.when(old == "", "empty").when(count == 0, "not found").when(count > 1, "ambiguous").otherwise("edited")
    return F.struct(status.alias("status"), count.alias("occurrences"), F.when((old != "") & (count == 1), F.replace(text, old, new)).otherwise(text).alias("edited"))


__all__ = ["Masked", "edit", "has_restorable", "kind_prefix", "mask", "placeholders", "restore", "splice", "summary"]

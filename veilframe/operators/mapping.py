"""The table of values and their placeholders: load, mint, save.

A mapping is a DataFrame (placeholder, value, kind, idx). Values are keyed by text alone: a value keeps the placeholder
of the kind it was first seen as. Numbers run per kind in first-seen order and go on from the largest in the table.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.kinds import KINDS
from veilframe.operators.detect import kind_prefix

MAPPING = "placeholder string, value string, kind string, idx bigint"
SPLIT = r"\A(.*)_([^_]*)\z"


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING)


def _named(prefix: Column) -> Column:
    out = F.lit(None).cast("string")
    for k in KINDS:
        out = F.when(prefix == k.prefix, k.name).otherwise(out)
    return out


def from_pairs(pairs: DataFrame) -> DataFrame:
    """A mapping from (placeholder, value). Placeholders of unknown form are kept but not counted; of several placeholders of one value the least is used."""
    prefix, index = F.regexp_extract("placeholder", SPLIT, 1), F.regexp_extract("placeholder", SPLIT, 2)
    kind = F.when(index.rlike(r"\A[0-9]{1,18}\z"), _named(prefix))
    return pairs.select("placeholder", "value", kind.alias("kind"), F.when(kind.isNotNull(), index.cast("bigint")).alias("idx"))


def _file(spark: SparkSession, path: str):
    """The file system of a path, and the path as that has it; both loading and saving go through it, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(os.path.expanduser(path))
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(at)


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The mapping in a JSON file {"values": {placeholder: value}}; empty if there is none, an error if it can't be read as such."""
    system, at = _file(spark, path)
    if not system.exists(at):
        return empty_mapping(spark)
    parsed = spark.read.text(at.toString(), wholetext=True).select(F.from_json("value", "struct<values:map<string,string>>", {"mode": "FAILFAST"}).alias("j"))
    return from_pairs(parsed.select(F.explode("j.values").alias("placeholder", "value")))


def save_mapping(mapping: DataFrame, path: str) -> None:
    """Write the mapping as that JSON file, readable by its owner alone, in place of an older one once it is complete.

    The file is one document for people and small tools; a large mapping is better kept as a table.
    """
    spark = mapping.sparkSession
    jvm = spark.sparkContext._jvm
    system, target = _file(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".mapping-{uuid.uuid4().hex}")
    private = jvm.org.apache.hadoop.fs.permission.FsPermission("600")
    if system.getScheme() == "file":
        system = system.getRaw()  # no checksum beside it, so that the file can be edited by hand
    system.mkdirs(target.getParent())
    try:
        created = system.create(temp, private, True, 1 << 16, system.getDefaultReplication(temp), system.getDefaultBlockSize(temp), None)
        system.setPermission(temp, private)
        out = jvm.java.io.OutputStreamWriter(created, "UTF-8")
        try:
            parts, comma = ['{\n  "values": {'], ""
            for r in mapping.select("placeholder", "value").orderBy("placeholder").toLocalIterator():
                parts.append(f"{comma}\n    {json.dumps(r['placeholder'], ensure_ascii=False)}: {json.dumps(r['value'], ensure_ascii=False)}")
                comma = ","
                if len(parts) == 1000:
                    out.write("".join(parts))
                    parts = []
            out.write("".join([*parts, "\n  }\n}"]))
        finally:
            out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        files.rename(temp, target, options)
    except BaseException:
        system.delete(temp, False)
        raise


def by_value(mapping: DataFrame) -> DataFrame:
    """(value, placeholder), one row per value: the least index wins where a hand-edited table has several."""
    return mapping.groupBy("value").agg(F.min_by("placeholder", F.struct(F.coalesce("idx", F.lit(2**62)), "placeholder")).alias("placeholder"))


def mint(seen: DataFrame, mapping: DataFrame, cached: list[DataFrame] | None = None) -> DataFrame:
    """New rows of the mapping for the values of seen (value, kind_ord, ord, start) that it lacks.

    Numbering per kind has few, unequal groups, so the values are dealt into ranges of their order, and a number is put
    together: the values of its kind in earlier ranges, plus its place in its own. Which range a row is in must not
    change between the two, so the ranges are stored, and appended to `cached` for the caller to release.
    """
    spark = seen.sparkSession
    place = F.struct("ord", "start")
    first = seen.groupBy("value").agg(F.min_by("kind_ord", place).alias("kind_ord"), F.min(place).alias("first"))
    fresh = first.join(mapping.select("value").distinct(), "value", "left_anti")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = fresh.repartitionByRange(ranges, "kind_ord", "first", "value").withColumn("range", F.spark_partition_id()).persist()
    if cached is not None:
        cached.append(dealt)
    earlier = dealt.groupBy("kind_ord", "range").count()
    earlier = earlier.select("kind_ord", "range", (F.sum("count").over(Window.partitionBy("kind_ord").orderBy("range")) - F.col("count")).alias("earlier"))
    taken = mapping.filter("kind IS NOT NULL").groupBy("kind").agg(F.max("idx").alias("taken"))
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("kind_ord", "range").orderBy("first", "value")))
    kind = F.get(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind_ord"))
    # At most a row for each kind and range, and one for each kind.
    out = numbered.join(F.broadcast(earlier), ["kind_ord", "range"]).withColumn("kind", kind).join(F.broadcast(taken), "kind", "left")
    idx = F.col("nth") + F.col("earlier") + F.coalesce("taken", F.lit(0))
    return out.select(F.concat_ws("_", kind_prefix(F.col("kind_ord")), idx.cast("string")).alias("placeholder"), "value", "kind", idx.cast("bigint").alias("idx"))


def remember(mapping: DataFrame, fresh: DataFrame) -> DataFrame:
    return mapping.unionByName(fresh)

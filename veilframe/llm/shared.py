"""What the operators of this folder share: tables in the cluster's shared folder, row ids, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import folders
from veilframe.functions.names import free_names, named

__all__ = ["SPACES", "chunks", "documents", "drop_path", "free_names", "made_since", "materialize", "named", "new_path", "release", "words"]

#: Between words: ASCII white space only, so that the JVM, Python's bytes.split and SQL agree.
SPACES = r"[\x20\x09-\x0D]+"
#: Tables stored by this process and not yet dropped, oldest first.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(folders.new_path(spark, name))
    return _made[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, fixes generated ids."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def made_since(count: int = 0) -> list[str]:
    """Paths of the tables stored after the first `count` of those that are still there."""
    return _made[count:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Drop stored tables once nothing is read from them any more."""
    for path in paths:
        drop_path(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(batch, column: str, most: int = 8 << 20):
    """Slices of an Arrow batch with about `most` bytes in a binary or string column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def words(text: Column) -> Column:
    """The words of a text between ASCII white space; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))

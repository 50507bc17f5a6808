"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import drop_path, new_path


def _stored(df: DataFrame, kept: list[str]) -> DataFrame:
    path = new_path(df.sparkSession, "stars")
    df.write.parquet(path)
    kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(pairs: DataFrame, large: bool, kept: list[str]) -> DataFrame:
    """One contraction of the distinct pairs (a, b), a > b.

    Large: every larger neighbour of a node moves to the node's least neighbour. Small: every smaller neighbour, and the
    node itself, does. The least neighbours are stored first, so that adaptive execution can split the join of a hub.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), kept)
    joined = both.join(least.hint("merge"), "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _stored(moved.filter("a > b").distinct(), kept)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (columns a and b of one orderable type); root is the least node."""
    spark, kept = edges.sparkSession, []
    pairs = _stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), kept)
    while True:
        older = list(kept)
        pairs = _star(_star(pairs, True, kept), False, kept)
        settled = pairs.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty() and pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        for path in older:
            drop_path(spark, path)
            kept.remove(path)
        if settled:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

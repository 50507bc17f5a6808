"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and judges all rows that its predecessor kept. All but the last return rows with
the columns they were given. run() applies them to documents, each stage written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.decontaminate import benchmark_hits
from veilframe.llm.packing import best_fit_packing
from veilframe.llm.quality_rules import quality_rules
from veilframe.llm.secrets import redact_secrets
from veilframe.llm.shared import made_since, materialize, release
from veilframe.llm.simhash import drop_near_duplicates


def _kept(judged: DataFrame, docs: DataFrame, condition: str) -> DataFrame:
    """Rows of judged that meet a condition on the columns after those of docs, with the columns of docs alone."""
    n = len(docs.columns)
    named = judged.toDF(*[f"_c{i}" for i in range(n)], *[f"_judged{i}" for i in range(len(judged.columns) - n)])
    return named.filter(condition).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _kept(quality_rules(docs), docs, "_judged3")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _kept(hits, docs, "NOT _judged0.contaminated")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay. n_chars, where given, follows the text."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has neither the estimate of the rules, nor XXH64, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. What a stage stores on its way goes as soon as its rows are stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(made_since())
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, made_since(before)[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)

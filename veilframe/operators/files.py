"""Folders of documents, masked: what the single-file tool does, for any number of files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.kinds import Settings
from veilframe.operators.mask import Masked, mask
from veilframe.sources import ocr
from veilframe.sources.documents import read_documents

CLEAN = "\n\n(no sensitive values found)"


def mask_files(spark: SparkSession, path: str, settings: Settings | None = None, mapping: DataFrame | None = None, engine: ocr.Engine | None = None, renderer: ocr.Renderer | None = None, max_bytes: int | None = None) -> Masked:
    """Every document under path, masked; values count as first seen in the order in which files were modified.

    df has path, modified, format, error, masked, report, n_masked, summary and note, the line a reader gets with the
    text. A file that can't be read has an error and no text: it is never reported as clean.
    """
    done = mask(read_documents(spark, path, engine, renderer, max_bytes), "text", "path", "modified", settings, mapping)
    told = F.concat(F.lit("\n\n("), F.col("n_masked").cast("string"), F.lit(" masked: "), F.col("summary"), F.lit(")"))
    note = F.when(F.col("masked").isNotNull(), F.when(F.col("n_masked") == 0, CLEAN).otherwise(told))
    done.df = done.df.drop("text").withColumn("note", note)
    return done

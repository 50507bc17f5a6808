"""Masking a stream: each micro-batch mints from, and adds to, one mapping table.

There must be one writer of a mapping. Everything a batch writes is named by its number, and a repeated batch starts
from the mapping as it was before it, so a batch that is run again after a failure writes the same rows in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilframe.kinds import Settings
from veilframe.operators import mapping as M
from veilframe.operators.mask import mask

BATCH = "_batch"


def known_before(spark, mapping_path: str, batch_id: int) -> DataFrame:
    """The mapping of all batches before this one; the partition column prunes the rest."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(mapping_path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return M.empty_mapping(spark)
    table = spark.read.schema(f"{M.MAPPING}, {BATCH} bigint").parquet(mapping_path)
    return table.filter(f"{BATCH} < {int(batch_id)}").drop(BATCH)


def mask_stream(stream: DataFrame, text_col: str, key: str, order_col: str, mapping_path: str, output_path: str, checkpoint: str, settings: Settings | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start masking: rows with their masked text go to output_path, new placeholders to mapping_path, both by batch."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = mask(batch, text_col, key, order_col, settings, known_before(spark, mapping_path, batch_id))
        done.fresh.write.mode("overwrite").parquet(f"{mapping_path}/{BATCH}={batch_id}")
        done.df.drop(text_col).write.mode("overwrite").parquet(f"{output_path}/{BATCH}={batch_id}")
        done.release()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Where tables and files go that driver and executors must both see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this process, which serves a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="veilframe-"))
        spark.sparkContext.setCheckpointDir(_own_folder[0])
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/veilframe-{name}-{uuid.uuid4().hex}"

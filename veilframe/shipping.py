"""Making this package importable in Python workers that were not started beside it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def reachable() -> bool:
    """Whether workers inherit a way to the package: the working directory or PYTHONPATH."""
    home = str(ROOT.parent)
    return home in map(os.path.realpath, [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))])


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, unless they have it anyway."""
    app = spark.sparkContext.applicationId
    if app in _shipped or reachable():
        return
    archive = Path(tempfile.mkdtemp(prefix="veilframe-")) / "veilframe.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)

"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HOME = Path(__file__).parent


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's Python files, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_boardloom_shipped", False):
        return
    to = os.path.join(tempfile.mkdtemp(prefix="boardloom-py-"), "boardloom_src.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_HOME.rglob("*")):
            if p.suffix in (".py", ".npz", ".json"):
                z.write(p, f"{_HOME.name}/{p.relative_to(_HOME)}")
    sc.addPyFile(to)
    sc._boardloom_shipped = True

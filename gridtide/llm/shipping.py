"""Executors get this package from the driver, so operators work from any folder and on any cluster."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="gridtide-py-")) / "gridtide"
        copied = target.with_name("tree")
        shutil.copytree(root, copied / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(target), "zip", copied))
        _SHIPPED.add(context.applicationId)
    return spark

"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "gridtide", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    partitions = os.cpu_count() if cores == "*" else int(cores)
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions),
                "spark.driver.memory": "8g", **conf}
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, shared by all executors.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    active = spark.sparkContext.getCheckpointDir()
    if active is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridtide-"))
        active = spark.sparkContext.getCheckpointDir()
    return active


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for an intermediate table."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_WRITTEN: dict[str, list[str]] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables this application has written; results that still read them end."""
    for name in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` has written and that nothing reads any more; other tables stay as they are."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            _delete(table.sparkSession, path)
            written = _WRITTEN.get(table.sparkSession.sparkContext.applicationId, [])
            if path in written:
                written.remove(path)


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go with its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back, for results that several branches read.

    A table rather than ``checkpoint()``: it computes the rows once instead of twice, and later
    reads take only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table

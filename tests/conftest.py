import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from gridtide.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def series(spark):
    """Builds a one-series table from a list of values, one per slot; None is missing."""
    from gridtide.plans.slots import slot_time
    from pyspark.sql import functions as F

    def build(values, start=0, keys=None):
        rows = [(start + i, None if v is None else float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "slot long, x double")
        for name, value in (keys or {}).items():
            df = df.withColumn(name, F.lit(value))
        return df.withColumn("ts", slot_time("slot", "H"))
    return build

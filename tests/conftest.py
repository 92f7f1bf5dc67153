import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame("a int, b string", rows) -> DataFrame."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a one-argument column function over values."""

    def evaluate(function, *values, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in rows]

    return evaluate

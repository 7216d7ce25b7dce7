import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from vacantia.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """``evaluate(fn, values)``: the value of ``fn(column)`` for each input string, in order."""
    from pyspark.sql import functions as F

    def run(fn, values, schema="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {schema}").repartition(1)
        return [row["o"] for row in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]

    return run

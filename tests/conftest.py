import os
import shutil
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from credence.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-")
    session = build_session("tests", "local[8]", 8, shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    shutil.rmtree(shared, ignore_errors=True)


@pytest.fixture
def one(spark):
    """Evaluate a Column on a single row."""
    def run(column, **values):
        from pyspark.sql import functions as F
        row = spark.range(1)
        for name, value in values.items():
            row = row.withColumn(name, F.lit(value))
        return row.select(column.alias("x")).first()["x"]
    return run

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

import os
import sys
import tempfile

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from adwatch.session import local_session

    session = local_session(4, "adwatch-tests", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="adwatch-checkpoint-")})
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="adwatch-test-")


@pytest.fixture
def column(spark):
    """Evaluate a column builder over a list of values (or tuples) and return the results in order."""

    def run(build, values, types="v string"):
        names = T.StructType.fromDDL(types).names
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, f"i int, {types}")
        out = df.select("i", build(*[F.col(n) for n in names]).alias("r")).collect()
        return [row["r"] for row in sorted(out, key=lambda r: r["i"])]

    return run

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path[:0] = [ROOT, str(Path(__file__).resolve().parent)]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402

from sonmai.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """The value of an expression over given columns: one(column, name=value, …)."""
    from pyspark.sql import types as T

    def kind(v):
        return T.StringType() if v is None or isinstance(v, str) else T.BinaryType() if isinstance(v, bytes) else T.LongType() if isinstance(v, int) else T.DoubleType()

    def run(c, **values):
        schema = T.StructType([T.StructField(k, kind(v)) for k, v in (values or {"_": 0}).items()])
        return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(c.alias("r")).collect()[0]["r"]

    return run

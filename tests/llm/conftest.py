import pytest
from pyspark.sql import functions as F


@pytest.fixture
def labels(spark):
    """labels(rows): rows of (label_id, full_text) with extra columns whose names clash with those the operators use."""

    def make(rows, **fields):
        t = spark.createDataFrame(rows, "label_id long, full_text string")
        for c in ("id", "fp", "a", "b", "s", "n", "value", "entity", "word", "block", "k", "part", "x"):
            t = t.withColumn(c, F.lit("clash"))
        return t

    return make

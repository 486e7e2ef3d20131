"""Tables of relational data bases, also where driver and executors have no memory in common."""

import os
import subprocess
import sys
from pathlib import Path

import oracle
import pyspark
import pytest

from sonmai.sources import files

D = f"{oracle.DATA}/sf0.001"
ON_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from sonmai.plans import catalogue
spark = SparkSession.builder.master("local-cluster[2,1,1200]").config(map={"spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared"}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
got = catalogue.QUERIES["database_table"](spark, sys.argv[2]).collect()
want = spark.read.parquet(f"{sys.argv[2]}/agency_ref.parquet").select("agency_id", "name", "short_name").collect()
assert want and sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
spark.stop()
"""


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_written_and_read_by_executors_of_their_own(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"SPARK_HOME": str(home), "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 700m pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", ON_CLUSTER, str(tmp_path), D], env=env, cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_database_keeps_rows(spark, tmp_path):
    rows = [(k, f"tên {k} '\"", None if k % 3 else k / 4, b"\0\1") for k in [*range(-50, 950), 7, 7, 2**63 - 1]] + [(None, None, None, None)] * 3
    t = spark.createDataFrame(rows, "`a key` long, name string, x double, b binary").repartition(6)
    at = f"file://{tmp_path}/of/its/own/d.sqlite"
    for _ in range(2):  # a table that is there is written anew
        files.write_database(t, at, 'the "table"', "a key")
    for parts in (1, 4, 7):
        got = files.database(spark, at, 'the "table"', "a key", t.schema.simpleString().removeprefix("struct<").removesuffix(">").replace("a key", "`a key`"), parts)
        assert got.dtypes == t.dtypes and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    files.write_database(t.where("false"), at, "none", "a key")
    assert files.database(spark, at, "none", "a key", "`a key` long, name string").collect() == []
    with pytest.raises(ValueError):
        files.write_database(t, "hdfs://h/d.sqlite", "t", "a key")


def test_jdbc_ranges(spark):
    t = spark.range(100).selectExpr("id AS k", "CAST(id AS string) AS name")
    url = "jdbc:derby:memory:ranges;create=true"
    t.write.format("jdbc").option("url", url).option("dbtable", "things").option("createTableColumnTypes", "name varchar(40)").save()
    got = files.jdbc(spark, url, "things", "k", 4, (0, 99))
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [(i, str(i)) for i in range(100)]
    with pytest.raises(ValueError):
        files.jdbc(spark, "", "things")

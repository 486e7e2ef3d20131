"""Reading the tables of a data directory, and a session for local use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the session comes from outside."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory of parquet files or folders."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that takes long for its bytes: a table of fewer splits than half the cores, as single small files are, goes to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one spark.checkpoint.dir names, deleted when the driver ends; where that is unset, in local runs, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sonmai_")
    path = f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path

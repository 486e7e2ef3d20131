"""Streams of processing logs (inventory T-1 to T-3): windows with late data, deduplication, the newest state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOGS = "log_id long, document_id long, stage string, status string, message string, duration double, created_at timestamp, ingested_at timestamp"


def read_logs(spark: SparkSession, path: str, schema: str = LOGS, files_per_batch: int = 64) -> DataFrame:
    """T-3: log files as they arrive in a folder; a path of one file stands for that file of its folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return r.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return r.parquet(path)


def stage_windows(logs: DataFrame, every: str = "1 day", late: str | None = "30 days", at: str = "created_at") -> DataFrame:
    """T-3: rows and seconds per stage and window of event time; rows later than the watermark are left out of a stream.

    late is None for a stream that has its watermark already.
    """
    t = logs.withWatermark(at, late) if logs.isStreaming and late else logs
    g = t.groupBy(F.window(at, every).alias("w"), "stage").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))
    return g.select(F.col("w.start").alias("window_start"), "stage", "n", "seconds")


def once(logs: DataFrame, late: str = "30 days", at: str = "created_at") -> DataFrame:
    """Rows repeated within the watermark count once."""
    return logs.withWatermark(at, late).dropDuplicatesWithinWatermark(["log_id", at]) if logs.isStreaming else logs.dropDuplicates(["log_id", at])


def sessions(logs: DataFrame, gap: str = "1 hour", late: str | None = "30 days", key: str = "document_id", at: str = "created_at") -> DataFrame:
    """Sessions of a key's rows; late as above."""
    t = logs.withWatermark(at, late) if logs.isStreaming and late else logs
    g = t.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def latest_in_batches(logs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """T-1, T-2: each batch's newest row per document is handed to write, which merges it into a table."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("document_id").agg(F.max_by(F.struct("stage", "status", "created_at"), F.struct("created_at", "log_id")).alias("s"))
        write(last.select("document_id", "s.*"), number)

    return logs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table of files and reads it."""
    if mode == "append":
        q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:  # the whole result of the last batch

        def replace(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(path)

        q = stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

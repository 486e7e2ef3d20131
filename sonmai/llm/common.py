"""Shared pieces of the text-corpus operators: shared-folder tables, stable hashes, folding and token caches."""

from __future__ import annotations

import hashlib
import tempfile
import unicodedata
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of our own in local runs, else an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sonmai_")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return d


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives the loss of any executor.

    The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def h64(s: str) -> int:
    """Stable 64-bit hash of a string, the same in every process."""
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bare_letters() -> dict[int, str]:
    table = {}
    for o in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and all(unicodedata.category(c) == "Mn" for c in d[1:]):
            table[o] = d[0]
    return table | {ord("đ"): "d", ord("Đ"): "D"} | {o: "" for o in range(0x300, 0x370)}


BARE_LETTERS = _bare_letters()


def strip_marks(s: str) -> str:
    """Without diacritics; đ becomes d. Case stays."""
    return s if s.isascii() else s.translate(BARE_LETTERS)


class Cache(dict):
    """A bounded memo of a function of one string; emptied when full, which changes no result."""

    def __init__(self, f, most: int = 400_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        v = self[key] = self.f(key)
        return v

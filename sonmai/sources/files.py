"""Readers and writers of files (inventory S1-S18, K1-K9, K13)."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Callable, Iterator
from contextlib import closing

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import docx_text

# Suffixes of inputs, and the beginnings of files by which their kind is known.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
MAGIC = {"25504446": "pdf", "89504E470D0A1A0A": "png", "FFD8FF": "jpg", "49492A00": "tiff", "4D4D002A": "tiff", "424D": "bmp"}
MIME = {"pdf": ("application/pdf",), "png": ("image/png",), "jpg": ("image/jpeg", "image/jpg"), "tiff": ("image/tiff",), "bmp": ("image/bmp", "image/x-ms-bmp")}
MOST_BYTES = 20 * 1024 * 1024
_SQLITE = {"tinyint": ("INTEGER", pa.int8()), "smallint": ("INTEGER", pa.int16()), "int": ("INTEGER", pa.int32()), "bigint": ("INTEGER", pa.int64()), "float": ("REAL", pa.float32()), "double": ("REAL", pa.float64()), "string": ("TEXT", pa.string()), "binary": ("BLOB", pa.binary())}


def scan(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = SUFFIXES, content: bool = True) -> DataFrame:
    """The files of a directory by suffix, whatever its case. Without content only names and sizes are read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    t = t.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*suffixes))
    return t if content else t.select("path", "modificationTime", "length")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as texts."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def docx(spark: SparkSession, directory: str, tables: bool = False) -> DataFrame:
    """S7, S8."""
    return scan(spark, directory, ("docx",)).select("path", docx_text(F.col("content"), tables).alias("text"))


def label_files(spark: SparkSession, path: str, schema: str = "filename string, full_text string, extraction struct<loai_van_ban:string,so_hieu:string,ngay_ban_hanh:string,co_quan_ban_hanh:string,trich_yeu:string,nguoi_ky:string>") -> DataFrame:
    """One JSON object per file, with the file's stem."""
    t = spark.read.schema(schema).json(path, multiLine=True)
    return t.withColumn("stem", F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1), r"\.[^.]*$", ""))


def keyed_records(spark: SparkSession, path: str, record: str = "loai_van_ban string, so_hieu string, ngay_ban_hanh string, co_quan_ban_hanh string, trich_yeu string, nguoi_ky string") -> DataFrame:
    """One JSON object of records by name: (name, record…)."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{', '.join(x.strip().replace(' ', ':') for x in record.split(','))}>>").alias("m"))
    return t.select(F.explode("m").alias("name", "r")).select("name", "r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manifest, relative paths below its root."""
    entry = "array<struct<id:string,input_path:string,input_sha256:string,label_path:string,label_sha256:string,split:string,source_type:string>>"
    t = spark.read.schema(f"schema_version string, root string, manifest_sha256 string, entries {entry}").json(path, multiLine=True)
    t = t.select("schema_version", "root", F.inline("entries"))
    full = lambda c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat_ws("/", F.regexp_replace("root", "/$", ""), c))
    return t.withColumns({"input_path": full("input_path"), "label_path": F.when(F.col("label_path").isNotNull(), full("label_path"))}).drop("root")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object per line; bad lines keep their text in _corrupt_record, blank ones are left out."""
    return spark.read.schema(schema + ", _corrupt_record string").json(path, mode="PERMISSIVE")


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 8, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table of a relational data base, read in ranges of a key. Fails where the address is empty."""
    if not url:
        raise ValueError("no data base address")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("numPartitions", parts).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
    return r.load()


def _sqlite(path: str, write: bool = False) -> closing:
    at = path.removeprefix("file:")
    at = "/" + at.lstrip("/") if at != path else path
    if "://" in at or not at.startswith("/"):
        raise ValueError(f"not a folder that all executors have mounted: {path}")
    if write:
        os.makedirs(os.path.dirname(at), exist_ok=True)
    return closing(sqlite3.connect(at, timeout=3600, isolation_level=None))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def write_database(df: DataFrame, path: str, name: str, key: str) -> None:
    """A new table, with an index on its key, in the SQLite file at path, which lies where all executors reach it. The
    rows of a task are added in one transaction, and only once however often the task is run."""
    table, done = _quoted(name), _quoted(name + "_written")
    columns = ", ".join(f"{_quoted(f.name)} {_SQLITE[f.dataType.simpleString()][0]}" for f in df.schema)
    with _sqlite(path, True) as c:
        c.execute(f"DROP TABLE IF EXISTS {table}")
        c.execute(f"DROP TABLE IF EXISTS {done}")
        c.execute(f"CREATE TABLE {table} ({columns})")
        c.execute(f"CREATE TABLE {done} (part INTEGER PRIMARY KEY)")
    marks = ", ".join("?" * len(df.columns))

    def add(batches):
        part, n = TaskContext.get().partitionId(), 0
        with _sqlite(path) as c:
            c.execute("BEGIN IMMEDIATE")
            if not c.execute(f"INSERT OR IGNORE INTO {done} VALUES (?)", (part,)).rowcount:
                c.execute("ROLLBACK")
                return
            for b in batches:
                c.executemany(f"INSERT INTO {table} VALUES ({marks})", zip(*(x.to_pylist() for x in b.columns)))
                n += b.num_rows
            c.execute("COMMIT")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    df.mapInArrow(add, "n long").collect()
    with _sqlite(path) as c:
        c.execute(f"DROP TABLE {done}")
        c.execute(f"CREATE INDEX {_quoted(name + '_key')} ON {table} ({_quoted(key)})")


def database(spark: SparkSession, path: str, name: str, key: str, schema: str, parts: int = 4) -> DataFrame:
    """The table that write_database() wrote, read in as many ranges of its whole-number key; rows without a key are in the first."""
    table, key = _quoted(name), _quoted(key)
    fields = spark.createDataFrame([], schema).schema
    with _sqlite(path) as c:
        least, most = c.execute(f"SELECT coalesce(min({key}), 0), coalesce(max({key}), 0) FROM {table}").fetchone()
    cuts = [least + (most - least + 1) * i // parts for i in range(parts + 1)]
    kinds = pa.schema([(f.name, _SQLITE[f.dataType.simpleString()][1]) for f in fields])
    names = ", ".join(_quoted(f.name) for f in fields)

    def read(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with _sqlite(path) as c:
                    rows = c.execute(f"SELECT {names} FROM {table} WHERE {key} BETWEEN ? AND ?" + (f" OR {key} IS NULL" if i == 0 else ""), (cuts[i], cuts[i + 1] - 1))
                    while got := rows.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), kinds.types)], schema=kinds)

    return spark.range(0, parts, 1, parts).mapInArrow(read, fields)


def file_kind(content: Column) -> Column:
    """The kind of a file by how it begins; NULL for others."""
    head = F.hex(F.substring(content, 1, 8))
    out = F
    for magic, kind in MAGIC.items():
        out = out.when(head.startswith(magic), kind)
    return out.otherwise(F.lit(None).cast("string"))


def rejection(content: Column, filename: Column, mime: Column) -> Column:
    """Why an upload is refused; NULL where it isn't."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    ext = F.when(ext == "jpeg", "jpg").when(ext == "tif", "tiff").otherwise(ext)
    kind = file_kind(content)
    ok = F.coalesce(mime == "application/octet-stream", F.lit(False)) | mime.isNull()
    for k, m in MIME.items():
        ok = ok | ((kind == k) & mime.isin(*m))
    return (
        F.when(F.length(content) == 0, "empty").when(F.length(content) > MOST_BYTES, "too large").when(~ext.isin(*MIME), "extension").when(kind.isNull(), "content").when(kind != ext, "content is not as named").when(~ok, "mime type")
    )


def pages(files: DataFrame, reader: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """The seam for readers of pages and for models: one function from a file's content to rows, called in
    Arrow batches. A file it can't read gives one row with its error instead of failing the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split()[0] for x in schema.split(",")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [{"path": path, "error": None, **r} for r in reader(content)]
                except Exception as e:  # noqa: BLE001
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:500]})
            out = pd.DataFrame([[r.get(c) for c in ("path", "error", *names)] for r in rows], columns=["path", "error", *names], dtype="object")
            yield out.where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def write_results(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """JSON lines without the columns that hold images."""
    df.drop(*drop).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """K4-K6, K8: JSON lines in a folder for each split or document."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K2: all values as text, with a header."""
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def write_text_rows(df: DataFrame, column: str, path: str) -> None:
    """K13."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def manifest_text(header: dict, entries: list[dict]) -> str:
    """K3: a manifest with its own hash, which leaves itself out."""
    import hashlib

    body = {**header, "entries": sorted(entries, key=lambda e: e["id"])}
    body.pop("manifest_sha256", None)
    canonical = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return json.dumps({**body, "manifest_sha256": hashlib.sha256(canonical.encode()).hexdigest()}, ensure_ascii=False, indent=2)


def write_named(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """K1, K8: one file per row, named by a column, written by the tasks themselves: (name, length) of each. A repeated task writes the same file again.

    folder is an address of any file system the tasks can reach; subfolders in names are made.
    """

    def write(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else "file://" + folder)
        made = set()
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{base.rstrip('/')}/{n}"
                if (up := path.rsplit("/", 1)[0]) not in made:
                    where.create_dir(up, recursive=True)
                    made.add(up)
                with where.open_output_stream(path) as f:
                    f.write(c or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c or b"") for c in batch.column(1).to_pylist()], pa.int64())], ["name", "length"])

    return df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(write, "name string, length long")


def usage(files: DataFrame) -> DataFrame:
    """Files and megabytes per directory."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).agg(F.count("*").alias("n_files"), (F.sum("length") / 1048576).alias("mb"))

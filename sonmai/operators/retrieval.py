"""Chunks, vectors and contexts (inventory G1-G7, S16, A32, A29, A30, J13, J16, O5, K15, F7)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, text


_OUTER = re.compile(r"^[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+$")


def cut_paragraphs(t: str | None, size: int, overlap: int, keep_short: bool) -> list[str]:
    done: list[str] = []
    parts: list[str] = []  # of the chunk at hand, and its length with line ends
    n = 0
    for line in (t or "").split("\n"):
        p = _OUTER.sub("", line)
        if not p:
            continue
        if parts and n + len(p) + 1 > size:
            cur = "\n".join(parts)
            done.append(cur)
            tail = cur[-overlap:] if len(cur) > overlap else cur if keep_short else ""
            parts, n = ([tail], len(tail)) if tail else ([], 0)
        n += len(p) + bool(parts)
        parts.append(p)
    return [*done, "\n".join(parts)] if parts else done


def paragraph_chunks(c: Column, size: int = 1000, overlap: int = 200, keep_short: bool = False) -> Column:
    """Paragraphs packed into chunks of at most size characters, each beginning with the end of the one before.

    Where the chunk before is not longer than the overlap, it is left out (G1) or repeated whole (G2, keep_short). One
    pass over a text, in Arrow batches: a fold of built-ins would copy all chunks for each new one.
    """

    @F.pandas_udf("array<string>")
    def chunks(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cut_paragraphs(t, size, overlap, keep_short))

    return chunks(text(c))


def chunk_rows(df: DataFrame, key: str, c: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(chunk_id, key, chunk_index, total_chunks, text) of every text; narrow."""
    t = df.select(F.col(key), paragraph_chunks(F.col(c), size, overlap).alias("_c"))
    t = t.select(key, F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "text"))
    return t.select(F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), key, "chunk_index", "total_chunks", "text")


def annotated(c: Column, index: Column, total: Column) -> Column:
    """G7."""
    return F.concat(c, F.format_string("\n[Đoạn %d/%d]", index + 1, total))


def cosine_distance(a: Column, b: Column) -> Column:
    """NULL where a vector is empty, zero, or of another length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
    return F.when(F.size(a) == F.size(b), 1.0 - F.try_divide(dot, norm(a) * norm(b)))


def nearest(vectors: DataFrame, query: list[float], k: int = 5, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors to one, a filter before; the query is a literal, the top k are taken per task first."""
    t = vectors if where is None else vectors.where(where)
    d = cosine_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return t.select("*", d.alias("distance")).where("distance IS NOT NULL").orderBy("distance", key).limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """J16, O5, F7 for a set of queries: (query_id, key, distance) of the k nearest vectors to each of queries' (key, vector).

    Blocks of queries meet blocks of vectors; each task keeps the top k of a query before they are merged.
    """
    d = lambda c: F.col(c).cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(total(F.transform(d(c), lambda v: v * v)))
    q = queries.select(F.col(key).alias("query_id"), d(vector).alias("_q"), norm(vector).alias("_qn"))
    t = (vectors if where is None else vectors.where(where)).select(key, d(vector).alias("_v"), norm(vector).alias("_vn"))
    dot = total(F.zip_with("_q", "_v", lambda x, y: x * y))
    met = q.crossJoin(t).where(F.size("_q") == F.size("_v")).select("query_id", key, (1.0 - F.try_divide(dot, F.col("_qn") * F.col("_vn"))).alias("distance"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return met.where("distance IS NOT NULL").withColumn("_r", best).where(F.col("_r") <= k).drop("_r")


def contexts(found: DataFrame, c: str = "text") -> DataFrame:
    """G5 for a set of queries: (query_id, context). found: top-k rows of each; c NULL where a vector has no text."""
    t = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("distance", F.col(c).alias("t"))))).alias("a"))
    return t.select("query_id", F.when(F.size("a") == 0, "Không tìm thấy thông tin liên quan.").otherwise(F.array_join(F.transform("a", lambda x: x["t"]), "\n---\n")).alias("context"))


def context(found: DataFrame, c: str = "text") -> DataFrame:
    """The texts joined in the order of their distance; a fixed answer for none. found: top-k rows."""
    t = found.agg(F.array_sort(F.collect_list(F.struct("distance", F.col(c).alias("t")))).alias("a"))
    return t.select(F.when(F.size("a") == 0, "Không tìm thấy thông tin liên quan.").otherwise(F.array_join(F.transform("a", lambda x: x["t"]), "\n---\n")).alias("context"))


class Collection:
    """A collection of vectors with their chunks, kept as a table of files in a folder, whatever writes it next.

    Each change writes a new version beside the old one and then points to it, so readers never see half a change.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version = 0

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}")

    def _replace(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{self.version + 1}")
        self.version += 1

    def put(self, new: DataFrame, key: str = "chunk_id") -> None:
        """K15."""
        self._replace(new if not self.version else upsert(self.read(), new, key))

    def drop(self, doc_id: object, key: str = "doc_id") -> None:
        """G6."""
        self._replace(without_document(self.read(), doc_id, key))

    def count(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def without_document(chunks: DataFrame, doc_id: object, key: str = "doc_id") -> DataFrame:
    """G6."""
    return chunks.where(F.col(key) != doc_id)


def merged_chunk_results(results: DataFrame, scalars: tuple[str, ...], lists: tuple[str, ...] = (), key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """One result per document from those of its chunks: the first filled scalars, lists joined in order without repeats."""
    agg = [F.min_by(F.col(s), F.when(F.trim(text(F.col(s))) != "", F.col(order))).alias(s) for s in scalars]
    agg += [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(l).alias("v")))), lambda x: x["v"]))).alias(l) for l in lists]
    return results.groupBy(key).agg(*agg)


def supports(value: Column, line: Column) -> Column:
    """Whether a line supports a value: one contains the other, or half the value's longer words stand in the line."""
    v, l = F.lower(strip(value)), F.lower(strip(line))
    long = F.filter(F.split(v, r"(?U)\s+"), lambda w: F.length(w) > 2)
    half = F.coalesce(F.try_divide(F.size(F.filter(long, lambda w: l.contains(w))), F.size(long)) >= 0.5, F.lit(False))
    return (v != "") & (l != "") & (v.contains(l) | l.contains(v) | half)


def evidence_lines(values: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """J13 of two tables: the join is by document, the rest a predicate on the few lines of one."""
    return values.join(lines, key).where(supports(F.col("value"), F.col("line")))


def joined_lines(lines: DataFrame, keys: tuple[str, ...], order: str, c: str = "text", sep: str = "\n") -> DataFrame:
    """The texts of a group in order; groups are pages or documents."""
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("t")))), lambda x: x["t"]), sep).alias("text"))


def islands(candidates: DataFrame, key: str, at: str, gap: int = 4) -> DataFrame:
    """The longest run of candidates whose places are at most gap apart, the first of equals: (key, first, last, n)."""
    w = Window.partitionBy(key).orderBy(at)
    t = candidates.withColumn("_g", F.sum(F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)).over(w))
    g = t.groupBy(key, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return g.groupBy(key).agg(F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("first"))).alias("b")).select(key, "b.*")

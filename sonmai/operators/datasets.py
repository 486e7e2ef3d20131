"""Training sets: deterministic splits and samples, instruction and conversation rows (inventory C1-C9, K4-K6, U7, F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prompt, strip, text


def hash_bucket(key: Column, buckets: int, seed: int = 42) -> Column:
    """A bucket from the digest of key and seed, the same on any engine and in any order."""
    h = F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 12)
    return F.pmod(F.conv(h, 16, 10).cast("long"), F.lit(buckets)).cast("int")


def split(key: Column, shares: tuple[tuple[str, int], ...] = (("train", 80), ("val", 10), ("test", 10)), seed: int = 42) -> Column:
    """The split of a row by the hash of its key."""
    b = hash_bucket(key, sum(n for _, n in shares), seed)
    out, at = F, 0
    for name, n in shares[:-1]:
        at += n
        out = out.when(b < at, name)
    return out.otherwise(shares[-1][0])


RANGE_ROWS = 200_000  # ranked in one task, about


def numbered(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds _r, the numbers 1 to n in the order of the key's hash, and _all, n: rows are ranked within ranges of the hash, as many as the rows ask for, and offset by the ranges before, so that no task holds all of them."""
    digits = 2
    n = df.count()
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    h = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key)))).withColumn("_b", F.substring("_h", 1, digits))
    sizes = h.groupBy("_b").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) + F.col("_off")
    return h.join(before, "_b").withColumn("_r", ranked).select(*df.columns, "_r", "_all")


def split_exact(df: DataFrame, key: str, cuts: tuple[float, float] = (0.8, 0.9), seed: int = 42) -> DataFrame:
    """Splits of exact sizes, rows in the order of their hashes."""
    r = numbered(df, key, seed)
    name = F.when(F.col("_r") <= F.floor(F.col("_all") * cuts[0]), "train").when(F.col("_r") <= F.floor(F.col("_all") * cuts[1]), "val").otherwise("test")
    return r.withColumn("split", name).select(*df.columns, "split")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows without replacement, those of the smallest hashes."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), key).limit(n)


def long_enough(c: Column, least: int) -> Column:
    """F8."""
    return F.length(strip(text(c))) >= least


# The folders of examples and the kinds of documents in them.
FOLDERS = {"CV": "Công văn", "HD": "Hợp đồng", "K": "Khác", "QD": "Quyết định", "TT": "Thông tư"}


def folder_kind(code: Column) -> Column:
    """The kind of a folder's documents."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), code), F.lit("Khác"))


def task_rows(df: DataFrame, key: str, body: str, kind: str) -> DataFrame:
    """A classification and an extraction row for each document."""
    cls = F.struct(F.lit("classify").alias("task"), F.lit("Phân loại văn bản sau.").alias("instruction"), F.col(body).alias("input"), text(F.col(kind)).alias("output"))
    ext = F.struct(F.lit("extract").alias("task"), F.lit("Trích xuất các trường của văn bản sau.").alias("instruction"), F.col(body).alias("input"), F.to_json("extraction").alias("output"))
    return df.select(key, F.inline(F.array(cls, ext)))


def drop_fields(record: Column, key: Column, fields: tuple[str, ...], share: int = 10, seed: int = 42) -> Column:
    """In share of 100 rows, one of the fields, picked by hash, becomes ''."""
    hit = hash_bucket(key, 100, seed) < share
    which = hash_bucket(key, len(fields), seed + 1)
    for i, f in enumerate(fields):
        record = F.when(hit & (which == i), record.withField(f, F.lit(""))).otherwise(record)
    return record


def made_up_number(key: Column, seed: int = 42) -> Column:
    """A document number from the hash of a key."""
    return F.concat((hash_bucket(key, 4999, seed) + 1).cast("string"), F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in ("QĐ", "TB", "CV", "KH")]), hash_bucket(key, 4, seed + 1) + 1), F.lit("-UBND"))


def made_up_date(key: Column, seed: int = 42) -> Column:
    """A date whose day is 28 at most."""
    return F.format_string("%02d/%02d/%d", hash_bucket(key, 28, seed) + 1, hash_bucket(key, 12, seed + 1) + 1, hash_bucket(key, 6, seed + 2) + 2019)


def composed_document(fields: Column, body: Column) -> Column:
    """Header, body and footer of a document from its fields."""
    g = lambda k: text(fields.getField(k))
    return F.concat_ws("\n", F.upper(g("co_quan_ban_hanh")), F.concat(F.lit("Số: "), g("so_hieu")), g("ngay_ban_hanh"), F.upper(g("loai_van_ban")), g("trich_yeu"), body, F.lit("Nơi nhận: Lưu: VT"), g("nguoi_ky"))


def training_text(instruction: Column, given: Column, answer: Column, end: str = "</s>") -> Column:
    """One text column of a training row."""
    t = "### Instruction:\n{a}\n\n### Input:\n{b}\n\n### Response:\n{c}"
    return F.concat(prompt(t, a=instruction, b=given, c=answer), F.lit(end))


def conversation(key: Column, question: Column, answer: Column) -> Column:
    """K6: a conversation of two turns as JSON."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.to_json(F.struct(key.cast("string").alias("id"), F.array(turn("human", question), turn("gpt", answer)).alias("conversations")))

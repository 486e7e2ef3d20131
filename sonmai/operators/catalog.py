"""Queries over the catalogue of documents, their extractions and their logs (inventory F1-F6, F15-F18, J1, J2, J9, A1-A8, O1, O2, K2, K16, K17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def latest_extractions(extractions: DataFrame) -> DataFrame:
    """One extraction per document: the newest, the greater id on ties."""
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))
    return extractions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def documents_with_extraction(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """Every document with its newest extraction, if any."""
    e = latest_extractions(extractions).withColumnRenamed("created_at", "extracted_at")
    return documents.join(e, documents["doc_id"] == e["document_id"], "left").drop("document_id")


def list_documents(documents: DataFrame, status: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """F1, O1: a page of documents, the newest first; doc_id breaks ties."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must not be negative, limit between 1 and 100")
    t = documents if status is None else documents.where(F.col("status") == status)
    return t.orderBy(F.desc("created_at"), F.desc("doc_id")).offset(skip).limit(limit)


def total(documents: DataFrame, status: str | None = None) -> DataFrame:
    """A1."""
    t = documents if status is None else documents.where(F.col("status") == status)
    return t.agg(F.count("*").alias("total"))


def get_document(documents: DataFrame, doc_id: int) -> DataFrame:
    """F2."""
    return documents.where(F.col("doc_id") == doc_id)


def search(joined: DataFrame, term: str = "", status: str = "all", file_type: str = "all") -> DataFrame:
    """a term in file name, kind, number or agency, whatever its case; facets; 'all' and a blank term pass."""
    t = joined
    if term.strip():
        q = F.lower(F.lit(term.strip()))
        hit = F.lit(False)
        for c in ("filename", "loai_van_ban", "so_hieu", "co_quan_ban_hanh"):
            hit = hit | F.lower(text(F.col(c))).contains(q)
        t = t.where(hit)
    if status != "all":
        t = t.where(F.col("status") == status)
    if file_type != "all":
        t = t.where(F.lower("file_type") == file_type.lower())
    return t


def storage_name(path: Column, filename: Column) -> Column:
    """the last part of the path, or the file's name."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"([^/\\]+)$", 1), F.lit("")), filename)


def document_view(joined: DataFrame) -> DataFrame:
    """what a client sees of a document."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return joined.select("doc_id", "filename", storage_name(F.col("file_path"), F.col("filename")).alias("storage_name"), "file_type", "status", iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"))


def within_root(path: Column, root: str) -> Column:
    """the path is the root or lies below it, without steps upwards."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+", "/")
    r = root.rstrip("/")
    return ((p == r) | p.startswith(r + "/")) & ~p.rlike(r"(?:^|/)\.\.(?:/|$)")


def page_path(pages: Column, n: Column, original: Column) -> Column:
    """the n-th page's path, or the original file where there is none."""
    return F.coalesce(F.when(n >= 1, F.try_element_at(pages, n)), original)


def status_counts(documents: DataFrame) -> DataFrame:
    """A2: one pass."""
    return documents.agg(F.count("*").alias("all"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "processing", "failed")])


def file_types(documents: DataFrame) -> DataFrame:
    """A3."""
    return documents.where("file_type IS NOT NULL").select(F.lower("file_type").alias("file_type")).distinct()


def dashboard(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """A4, A5: mean processing time of completed documents and the success rate; 0 for an empty table."""
    t = documents_with_extraction(documents, extractions)
    done = F.col("status") == "completed"
    return t.agg(
        F.round(F.coalesce(F.avg(F.when(done, F.coalesce("processing_time", F.lit(0.0)))), F.lit(0.0)), 1).alias("avg_seconds"),
        F.round(F.coalesce(100.0 * F.count_if(done) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 1).alias("success_percent"),
    )


def by_weekday(documents: DataFrame, at: str = "created_at") -> DataFrame:
    """Documents per day of the week, days without any too, and each as a share of the greatest."""
    n = documents.where(F.col(at).isNotNull()).groupBy(F.weekday(at).alias("day")).agg(F.count("*").alias("n"))
    days = documents.sparkSession.range(7).select(F.col("id").cast("int").alias("day"))
    t = days.join(F.broadcast(n), "day", "left").select("day", F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day") + 1).alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    return t.withColumn("bar", F.col("n") / F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1)))  # seven rows


def by_kind(extractions: DataFrame) -> DataFrame:
    """A7."""
    return extractions.groupBy(F.coalesce(F.nullif(F.trim("loai_van_ban"), F.lit("")), F.lit("Other")).alias("kind")).agg(F.count("*").alias("n"))


def log_counts(documents: DataFrame, logs: DataFrame) -> DataFrame:
    """Documents with the numbers of their log rows; the logs are counted before they are joined, as one document may hold a tenth of them."""
    n = logs.groupBy("document_id").agg(F.count("*").alias("n_logs"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return documents.join(n, documents["doc_id"] == n["document_id"], "left").select("doc_id", F.coalesce("n_logs", F.lit(0)).alias("n_logs"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def apply_edits(extractions: DataFrame, edits: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields that an edit supplies replace the old ones; the edit is kept as JSON and the row counts as verified."""
    e = edits.select(F.col("id"), *[F.col(f).alias(f"_e_{f}") for f in fields], F.lit(True).alias("_edited"))
    t = extractions.join(e, "id", "left")
    supplied = F.to_json(F.struct(*[F.col(f"_e_{f}").alias(f) for f in fields]))
    new = {f: F.coalesce(f"_e_{f}", f) for f in fields}
    new |= {"edited_json": F.when(F.col("_edited"), supplied).otherwise(F.col("edited_json")), "verified_by_user": F.coalesce(F.col("_edited"), F.col("verified_by_user"))}
    return t.withColumns(new).select(*extractions.columns)


def delete_documents(ids: DataFrame, documents: DataFrame, extractions: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents and all that refers to them. ids: (doc_id)."""
    gone = ids.select(F.col("doc_id").alias("document_id"))
    return documents.join(ids, "doc_id", "left_anti"), extractions.join(gone, "document_id", "left_anti"), logs.join(gone, "document_id", "left_anti")


def export_record(extractions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """K2: what is exported of an extraction: the user's edit where it is JSON, else the raw reply, else the row."""
    row = F.to_json(F.struct(*[text(F.col(f)).alias(f) for f in fields]))
    valid = lambda c: F.when(F.try_parse_json(F.nullif(F.trim(c), F.lit(""))).isNotNull(), F.col(c))
    return extractions.select("id", F.coalesce(valid("edited_json"), valid("raw_json"), row).alias("record"), F.when(valid("edited_json").isNotNull(), "edited").when(valid("raw_json").isNotNull(), "raw").otherwise("row").alias("origin"))


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """O2: by the first number in a name, then the name."""
    return df.orderBy(F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")), F.lit("999999999999")).asc_nulls_last(), name)


def stage_latency(logs: DataFrame) -> DataFrame:
    """Seconds per stage, their share of all, and whether the stage is the slowest."""
    t = logs.where("stage IS NOT NULL").groupBy("stage").agg(F.sum("duration").alias("seconds"), F.max("duration").alias("longest"), F.count("duration").alias("n"))
    all_ = Window.partitionBy()  # one row per stage
    return t.withColumns({"share": F.col("seconds") / F.sum("seconds").over(all_), "slowest": F.col("seconds") == F.max("seconds").over(all_)})


def without_repeated_messages(logs: DataFrame) -> DataFrame:
    """Log rows that don't repeat the message before them in their document; rows repeated in full count once.

    A document may hold a great part of all logs, so rows are looked at within a document's days; the last message of
    each day is carried over to the first row of the next one there is.
    """
    day = F.date_trunc("day", "created_at")
    t = logs.dropDuplicates().withColumn("_day", day)
    within = Window.partitionBy("document_id", "_day").orderBy("created_at", "log_id")
    t = t.withColumns({"_before": F.lag("message").over(within), "_r": F.row_number().over(within)})
    seam = logs.groupBy("document_id", day.alias("_day")).agg(F.max_by(F.struct("message"), F.struct("created_at", "log_id")).alias("_m"))
    days = Window.partitionBy("document_id").orderBy("_day")
    seam = seam.withColumn("_last", F.lag("_m").over(days)).select(F.col("document_id").alias("_d"), F.col("_day").alias("_e"), "_last")
    j = t.join(seam, F.col("document_id").eqNullSafe(F.col("_d")) & F.col("_day").eqNullSafe(F.col("_e")))
    repeats = F.when(F.col("_r") > 1, F.col("message").eqNullSafe(F.col("_before"))).otherwise(F.col("_last").isNotNull() & F.col("message").eqNullSafe(F.col("_last.message")))
    return j.where(~repeats).select(*logs.columns)


def latest_state(logs: DataFrame) -> DataFrame:
    """T-2: the newest stage and status of each document, and its step."""
    last = F.max_by(F.struct("stage", "status"), F.struct("created_at", "log_id"))
    t = logs.groupBy("document_id").agg(last.alias("s"))
    steps = ("preprocessing", "stamp_detection", "ocr", "llm", "validation")
    return t.select("document_id", "s.stage", "s.status", F.array_position(F.array(*[F.lit(x) for x in steps]), F.col("s.stage")).cast("int").alias("step"))


EXTRACTION_VIEW = ("id", "document_id", "loai_van_ban", "so_hieu", "ngay_ban_hanh", "co_quan_ban_hanh", "trich_yeu", "nguoi_ky", "ocr_confidence", "llm_confidence", "total_stamps", "stamp_coordinates", "processing_time", "verified_by_user", "raw_json", "edited_json")


def extraction_view(extractions: DataFrame) -> DataFrame:
    """what a client sees of an extraction."""
    return extractions.select(*EXTRACTION_VIEW)


def repaired_names(documents: DataFrame, files: DataFrame) -> DataFrame:
    """F16: documents named as a page of themselves get the name and kind of their original where it is among files (path), else the kind if they have several pages."""
    hit = F.col("filename").rlike(r"^[a-f0-9]{32}_page_\d+\.jpg$")
    stem = F.regexp_extract("filename", "^([a-f0-9]{32})_page_", 1)
    folder = F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1)
    t = documents.withColumn("_original", F.when(hit, F.concat(folder, stem, F.lit(".pdf"))))
    t = t.join(files.select(F.col("path").alias("_original"), F.lit(True).alias("_there")).distinct(), "_original", "left")
    there = F.coalesce("_there", F.lit(False))
    new = {
        "file_path": F.when(there, F.col("_original")).otherwise(F.col("file_path")),
        "filename": F.when(there, F.concat(stem, F.lit(".pdf"))).otherwise(F.col("filename")),
        "file_type": F.when(there | (hit & (F.col("num_pages") > 1)), "pdf").otherwise(F.col("file_type")),
    }
    return t.withColumns(new).select(*documents.columns)


def page_texts(texts: DataFrame, key: str, c: str, separator: str = "\f") -> DataFrame:
    """(key, page, text), pages numbered from 1."""
    return texts.select(key, F.posexplode(F.split(c, separator)).alias("page", "text")).withColumn("page", F.col("page") + 1)

"""The queries of the text-corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, bpe, canonical, chunking, confusables, evalleak, neardup, ocr_repair, splitleak, variants


def narrow(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table as it lies, for work on a few short columns."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table; of fewer splits than half the cores, as single small files are, it is spread over all."""
    t = narrow(spark, directory, name)
    cores = spark.sparkContext.defaultParallelism
    return t if t.rdd.getNumPartitions() * 2 > cores else t.repartition(cores)


def p1_found(spark, d):
    r = neardup.near_duplicates(table(spark, d, "bench_labels"), "label_id", "full_text")
    return r.select(F.col("a").alias("label_id_a"), F.col("b").alias("label_id_b"))


def p1_groups(spark, d):
    """One row per label with its class of equal texts and the number of other classes it is linked to."""
    r = neardup.duplicate_groups(table(spark, d, "bench_labels"), "label_id", "full_text")
    return r.withColumnRenamed("id", "label_id")


def p2_found(spark, d):
    return chunking.oversized(table(spark, d, "bench_labels"), "label_id", "full_text")


def p2_pieces(spark, d):
    """The pieces of every text, with their places in it."""
    return chunking.pieces(table(spark, d, "bench_labels"), "label_id", "full_text")


def p3_found(spark, d):
    return ocr_repair.damage_found(table(spark, d, "bench_labels"), "label_id", "full_text")


def p3_repaired(spark, d):
    """The repaired text of every label, with counts of what was repaired."""
    return ocr_repair.repair_texts(table(spark, d, "bench_labels"), "label_id", "full_text")


def p4_found(spark, d):
    return splitleak.found(narrow(spark, d, "manifest_entries"), table(spark, d, "bench_labels"))


def p4_report(spark, d):
    """Overlapping val and test entries per split and source type."""
    return splitleak.report(narrow(spark, d, "manifest_entries"), table(spark, d, "bench_labels"))


_FIELDS = {"full_text": "full_text", "trich_yeu": "extraction.trich_yeu"}


def p5_found(spark, d):
    return confusables.inconsistent_values(table(spark, d, "bench_labels"), "label_id", _FIELDS).select("label_id", "field")


def p5_consistent(spark, d):
    """Both fields of every label in their one consistent form."""
    t = table(spark, d, "bench_labels")
    return confusables.with_consistent(t, {"full_text_c": "full_text", "trich_yeu_c": "extraction.trich_yeu"}).select("label_id", "full_text_c", "trich_yeu_c")


def p5_groups(spark, d):
    """Subjects grouped by equal skeleton, with the number of rows and of spellings."""
    t = table(spark, d, "bench_labels").select(F.col("extraction.trich_yeu").alias("v"))
    return confusables.skeleton_groups(t, "v").select("consistent", "n_rows", "n_spellings")


def _canonical(spark, d):
    types = canonical.reference_rows(narrow(spark, d, "doc_type_ref"), "type_id", "name", "code")
    agencies = canonical.reference_rows(narrow(spark, d, "agency_ref"), "agency_id", "name", "short_name")
    fields = {"loai_van_ban": ("extraction.loai_van_ban", types, "type"), "co_quan_ban_hanh": ("extraction.co_quan_ban_hanh", agencies, "agency")}
    return canonical.canonical_map(narrow(spark, d, "bench_labels"), "label_id", fields)


def p6_found(spark, d):
    return _canonical(spark, d).where("NOT exact").select("label_id", "field", "ref_id")


def p6_misses(spark, d):
    """Values that fit no entry, with their numbers of rows."""
    return canonical.misses(_canonical(spark, d))


def _entities(spark, d):
    known = narrow(spark, d, "agency_ref").select(F.col("name").alias("value"))
    return variants.entities(narrow(spark, d, "bench_labels"), {"co_quan_ban_hanh": "extraction.co_quan_ban_hanh"}, {"nguoi_ky": "extraction.nguoi_ky"}, known)


def p7_found(spark, d):
    return variants.linked(_entities(spark, d))


def p7_classes(spark, d):
    """Every spelling with its entity and the number of spellings it is linked to."""
    return variants.classes(_entities(spark, d))


def p7_entities(spark, d):
    """Spellings and rows of each entity."""
    return _entities(spark, d).groupBy("field", "entity").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows"))


def p8_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"))


def p8_roundtrip(spark, d):
    """Whether decoding gives each text back, with its number of ids."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.decode(bpe.encode(docs))
    return back.join(docs, "doc_id").select("doc_id", F.size("ids").alias("n_ids"), (F.col("decoded") == F.col("text")).alias("same"))


def p9_found(spark, d):
    return evalleak.found(table(spark, d, "documents"), narrow(spark, d, "eval_items"))


def p9_near(spark, d):
    """Leaks with at most one word of a window changed."""
    return evalleak.near(table(spark, d, "documents"), narrow(spark, d, "eval_items"))


def p9_report(spark, d):
    """Leaked items and documents per evaluation split, task and source."""
    return evalleak.report(table(spark, d, "documents"), narrow(spark, d, "eval_items"))


def p10_found(spark, d):
    return abuse.found(table(spark, d, "documents"), narrow(spark, d, "review_labels"))


def p10_scores(spark, d):
    """A score for each category of every document."""
    return abuse.scores(table(spark, d, "documents"), narrow(spark, d, "review_labels"))


def p10_rates(spark, d):
    """Rates of flagged documents per source."""
    return abuse.rates(table(spark, d, "documents"), narrow(spark, d, "review_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_repaired, p4_found, p4_report, p5_found, p5_consistent, p5_groups, p6_found, p6_misses, p7_found, p7_classes, p7_entities, p8_ids, p8_roundtrip, p9_found, p9_near, p9_report, p10_found, p10_scores, p10_rates)
}

def _words(table: str, key: str) -> str:
    plain = "translate(lower(strip_accents(regexp_replace(text, '[\\x{AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g'))), 'đ', 'd')"
    return f"SELECT {key}, regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL"


def _windows(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS win FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM ({_words(table, key)}) WHERE len(w) >= 12)"


ORACLE: dict[str, str] = {
    "p9_found": f"""SELECT DISTINCT d.doc_id AS doc_id, i.item_id AS item_id FROM ({_windows('documents', 'doc_id')}) d JOIN ({_windows('eval_items', 'item_id')}) i USING (win)
        UNION SELECT d.doc_id AS doc_id, i.item_id AS item_id FROM ({_words('documents', 'doc_id')}) d JOIN ({_words('eval_items', 'item_id')}) i
          ON len(i.w) BETWEEN 1 AND 11 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')""",
    "p2_found": r"""
        SELECT label_id, CAST(max(CASE WHEN length(run) > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS forced
        FROM (SELECT label_id, unnest(regexp_split_to_array(full_text, '\s')) AS run FROM bench_labels WHERE length(full_text) > 2000)
        GROUP BY label_id""",
}

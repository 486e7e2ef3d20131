"""All queries of the core, by name, with the inventory they stand for, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import extract as X
from ..functions import layout as L
from ..functions import metrics as M
from ..functions import text as T
from ..functions import udfs as U
from ..operators import catalog as C
from ..operators import datasets as S
from ..operators import evaluation as E
from ..operators import governance as G
from ..operators import retrieval as R
from ..session import shared_folder, spread, table
from ..streaming import logs as LOGS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# DuckDB's regular expressions know neither \s beyond ASCII nor look-ahead; these say the same in its dialect.
WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _ws(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def _punct(c: str) -> str:
    t = f"translate({_ws(c)}, '{''.join(T.PUNCTUATION)}', '{''.join(T.PUNCTUATION.values()).replace(chr(39), chr(39) * 2)}')"
    t = f"replace({t}, '…', '...')"
    t = f"regexp_replace({t}, '{WS}+([,.;:!?/\\-])', '\\1', 'g')"
    t = f"regexp_replace({t}, '([(/\\-]){WS}+', '\\1', 'g')"
    t = f"regexp_replace({t}, '([,.;:!?])', '\\1 ', 'g')"
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def _fold(c: str) -> str:
    return f"replace(lower({_punct(c)}), 'ß', 'ss')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _iso(c: str) -> str:
    """An ISO date of a folded text that is wholly a date, else NULL."""
    num = f"regexp_matches({c}, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}$')"
    vi = f"regexp_matches({c}, '^ng[aà]y\\s+\\d{{1,2}}\\s+th[aá]ng\\s+\\d{{1,2}}\\s+n[aă]m\\s+\\d{{4}}$')"
    d, m, y = (f"regexp_extract({c}, '^(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{4}})$', {i})" for i in (1, 2, 3))
    e, n, z = (f"regexp_extract({c}, '^ng[aà]y\\s+(\\d{{1,2}})\\s+th[aá]ng\\s+(\\d{{1,2}})\\s+n[aă]m\\s+(\\d{{4}})$', {i})" for i in (1, 2, 3))
    return (
        f"CASE WHEN {num} THEN strftime(try_strptime({d} || '/' || {m} || '/' || {y}, '%d/%m/%Y'), '%Y-%m-%d') "
        f"WHEN {vi} THEN strftime(try_strptime({e} || '/' || {n} || '/' || {z}, '%d/%m/%Y'), '%Y-%m-%d') END"
    )


# --- corpus and text ------------------------------------------------------------------------------------------------


@query(f"""SELECT lang, source, count(*) AS n_docs, CAST(sum(length(x)) AS BIGINT) AS n_chars, CAST(sum(length(x) - length(replace(x, ' ', '')) + 1) AS BIGINT) AS n_words
    FROM (SELECT lang, source, {_fold('text')} AS x FROM documents) WHERE x <> '' GROUP BY lang, source""")
def corpus_profile(spark, d):
    t = spread(table(spark, d, "documents").select("lang", "source", "text")).select("lang", "source", T.case_fold(F.col("text")).alias("x")).where("x <> ''")
    return t.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(F.length("x")).alias("n_chars"), F.sum(F.size(F.split("x", " "))).cast("long").alias("n_words"))


@query(f"SELECT doc_id, md5({_ws('text')}) AS h FROM documents")
def norm_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, md5({_punct('text')}) AS h FROM documents")
def norm_punct(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(T.plain_punctuation(F.col("text"))).alias("h"))


@query(f"SELECT label_id, {_fold('extraction.trich_yeu')} AS folded FROM bench_labels")
def norm_casefold(spark, d):
    return table(spark, d, "bench_labels").select("label_id", T.case_fold(F.col("extraction.trich_yeu")).alias("folded"))


@query(f"SELECT doc_id, md5(regexp_replace(translate(coalesce(text, ''), '{T.ACCENTED}', '{T.UNACCENTED}'), '\\p{{Mn}}', '', 'g')) AS h FROM documents")
def norm_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.remove_accents(F.col("text"))).alias("h"))


@query("SELECT label_id, md5(nfc_normalize(coalesce(full_text, ''))) AS h FROM bench_labels")
def norm_nfc(spark, d):
    return table(spark, d, "bench_labels").select("label_id", F.md5(T.nfc(F.col("full_text"))).alias("h"))


@query(
    "SELECT doc_id, coalesce(length(text), 0) AS n_chars, CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END AS n_words, left(x, 800) AS preview FROM "
    f"(SELECT doc_id, text, {_ws('text')} AS x FROM documents)"
)
def text_stats(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.length(c), F.lit(0)).cast("long").alias("n_chars"), T.word_count(c).cast("long").alias("n_words"), F.left(T.collapse(c), F.lit(800)).alias("preview"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE CASE WHEN cut <> '' THEN cut ELSE left(text, 300) END || '...' END AS short
    FROM (SELECT doc_id, text, regexp_extract(left(text, 300), '(?s)^(.*)[ \\n]', 1) AS cut FROM documents WHERE text IS NOT NULL)""")
def truncate_budget(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.truncate_words(F.col("text"), 300).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 400) || chr(10) || '...' || chr(10) || right(text, 200) END AS short FROM documents WHERE text IS NOT NULL")
def truncate_smart(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.truncate_middle(F.col("text"), 600).alias("short"))


def _phrases(c: str) -> str:
    for a, b in T.PHRASES.items():
        c = f"replace({c}, '{a}', '{b}')"
    c = f"regexp_replace({c}, 'Số{WS}*:{WS}*', 'Số: ', 'g')"
    c = f"regexp_replace({c}, '[Vv]{WS}*/{WS}*[Vv]{WS}*:', 'V/v:', 'g')"
    c = _strip(f"regexp_replace({c}, '[ \\t]+', ' ', 'g')")
    return f"regexp_replace({c}, '{WS}+([.,;:!?])', '\\1', 'g')"


@query(f"SELECT label_id, md5({_phrases('full_text')}) AS h FROM bench_labels")
def ocr_postprocess(spark, d):
    return table(spark, d, "bench_labels").select("label_id", F.md5(T.postprocess(F.col("full_text"))).alias("h"))


@query()
def ocr_domain_corrections(spark, d):
    return table(spark, d, "bench_labels").select("label_id", T.domain_corrections(F.col("full_text")).alias("text"))


@query()
def born_digital(spark, d):
    return table(spark, d, "bench_labels").groupBy(T.born_digital(F.col("full_text")).alias("digital")).agg(F.count("*").alias("n"))


@query("""SELECT label_id, round(CASE WHEN a = 0 THEN NULL ELSE b / a END, 9) AS ratio FROM
    (SELECT label_id, CAST(length(regexp_replace(x, '[^\\p{L}]', '', 'g')) AS DOUBLE) AS a, length(regexp_replace(x, '[^\\p{Lu}]', '', 'g')) AS b FROM (SELECT label_id, extraction.co_quan_ban_hanh AS x FROM bench_labels))""")
def upper_ratio(spark, d):
    return table(spark, d, "bench_labels").select("label_id", F.round(T.upper_ratio(F.col("extraction.co_quan_ban_hanh")), 9).alias("ratio"))


@query()
def scan_noise(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.scan_noise(F.col("text"), F.col("doc_id")).alias("noisy"))


@query("""SELECT doc_id, round(file_size / 1024.0::DOUBLE, 1) || ' KB' AS size, CASE WHEN num_pages >= 95 THEN 'high' WHEN num_pages >= 80 THEN 'medium' ELSE 'low' END AS level FROM upload_files WHERE file_size IS NOT NULL""")
def display_labels(spark, d):
    return table(spark, d, "upload_files").where("file_size IS NOT NULL").select("doc_id", T.size_label(F.col("file_size")).alias("size"), T.confidence_level(F.col("num_pages")).alias("level"))


# --- dates ----------------------------------------------------------------------------------------------------------


@query(f"SELECT label_id, {_iso('x')} AS iso, coalesce({_iso('x')}, x) AS comparable FROM (SELECT label_id, {_fold('extraction.ngay_ban_hanh')} AS x FROM bench_labels)")
def date_normalize(spark, d):
    c = F.col("extraction.ngay_ban_hanh")
    return table(spark, d, "bench_labels").select("label_id", D.iso_date(c).alias("iso"), D.comparable_value(c, True).alias("comparable"))


@query("""SELECT label_id, CASE WHEN y IN ('01/01/2023', '01/01/1970', '01/01/2000', '01/01/2024') THEN '' ELSE y END AS day_first FROM (
    SELECT label_id, CASE WHEN regexp_matches(x, '^\\d{2}/\\d{2}/\\d{4}$') THEN x
      WHEN regexp_matches(x, '\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{4}') THEN lpad(regexp_extract(x, '(\\d{1,2})[/\\-](\\d{1,2})[/\\-](\\d{4})', 1), 2, '0') || '/' || lpad(regexp_extract(x, '(\\d{1,2})[/\\-](\\d{1,2})[/\\-](\\d{4})', 2), 2, '0') || '/' || regexp_extract(x, '(\\d{1,2})[/\\-](\\d{1,2})[/\\-](\\d{4})', 3)
      WHEN regexp_matches(x, '\\d{4}-\\d{2}-\\d{2}') THEN regexp_extract(x, '(\\d{4})-(\\d{2})-(\\d{2})', 3) || '/' || regexp_extract(x, '(\\d{4})-(\\d{2})-(\\d{2})', 2) || '/' || regexp_extract(x, '(\\d{4})-(\\d{2})-(\\d{2})', 1)
      ELSE x END AS y FROM (SELECT label_id, coalesce(extraction.ngay_ban_hanh, '') AS x FROM bench_labels))""")
def date_output(spark, d):
    return table(spark, d, "bench_labels").select("label_id", D.without_defaults(D.day_first(T.text(F.col("extraction.ngay_ban_hanh")))).alias("day_first"))


# --- extraction -----------------------------------------------------------------------------------------------------


def _kind_case(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, '{k.lower()}') THEN '{k}'" for k in X.SEARCHED) + f" ELSE '{X.OTHER}' END"


@query(f"""SELECT label_id, {_kind_case('lower(x)')} AS loai_van_ban, regexp_extract(x, '[Ss]ố[:\\s]+(\\p{{Nd}}+[/\\-][A-ZĐa-zđ\\p{{Nd}}/\\-]+)', 1) AS so_hieu,
    CASE WHEN regexp_matches(x, '(?i)ngày\\s+\\p{{Nd}}{{1,2}}\\s+tháng\\s+\\p{{Nd}}{{1,2}}\\s+năm\\s+\\p{{Nd}}{{4}}') THEN
      lpad(regexp_extract(x, '(?i)ngày\\s+(\\p{{Nd}}{{1,2}})\\s+tháng\\s+(\\p{{Nd}}{{1,2}})\\s+năm\\s+(\\p{{Nd}}{{4}})', 1), 2, '0') || '/' || lpad(regexp_extract(x, '(?i)ngày\\s+(\\p{{Nd}}{{1,2}})\\s+tháng\\s+(\\p{{Nd}}{{1,2}})\\s+năm\\s+(\\p{{Nd}}{{4}})', 2), 2, '0')
      || '/' || regexp_extract(x, '(?i)ngày\\s+(\\p{{Nd}}{{1,2}})\\s+tháng\\s+(\\p{{Nd}}{{1,2}})\\s+năm\\s+(\\p{{Nd}}{{4}})', 3) ELSE '' END AS ngay_ban_hanh
    FROM (SELECT label_id, regexp_replace(coalesce(full_text, ''), '{WS}', ' ', 'g') AS x FROM bench_labels)""")
def regex_extract(spark, d):
    t = table(spark, d, "bench_labels").select("label_id", F.regexp_replace(T.text(F.col("full_text")), r"(?U)\s", " ").alias("x"))
    return t.select("label_id", X.by_search(F.col("x")).alias("e")).select("label_id", "e.loai_van_ban", "e.so_hieu", "e.ngay_ban_hanh")


@query()
def extract_fields(spark, d):
    """Search, enrichment from the text, validation and header override in their order."""
    t = spread(table(spark, d, "bench_labels").select("label_id", "full_text")).select("label_id", F.explode(F.array(T.domain_corrections(T.postprocess(F.col("full_text"))))).alias("x"))
    # a generator after each stage keeps the optimizer from merging the stages, which would compute each field's rules once per use
    for stage in (lambda e, x: X.by_search(x), X.enriched, lambda e, x: X.validated(e), X.header_override):
        e = F.col("e") if "e" in t.columns else None
        t = t.select("label_id", "x", F.explode(F.array(stage(e, F.col("x")))).alias("e"))
    return t.select("label_id", "e.*")


@query()
def weak_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", X.weak_labels(F.col("text")).alias("e")).select("doc_id", "e.*")


_KINDS = ", ".join(f"('{k.lower()}', '{k}')" for k in X.KINDS)


@query(f"SELECT label_id, coalesce(k.name, '{X.OTHER}') AS kind FROM bench_labels LEFT JOIN (VALUES {_KINDS}) k(low, name) ON lower({_strip(chr(99) + 'oalesce(extraction.loai_van_ban, ' + chr(39) * 2 + ')')}) = k.low")
def canonical_kind(spark, d):
    return table(spark, d, "bench_labels").select("label_id", X.canonical_kind(F.col("extraction.loai_van_ban")).alias("kind"))


@query()
def cased_agency(spark, d):
    return table(spark, d, "bench_labels").select("label_id", X.cased_agency(F.col("extraction.co_quan_ban_hanh")).alias("agency"))


@query(
    "SELECT label_id, "
    + _strip("regexp_replace(regexp_replace(coalesce(extraction.trich_yeu, ''), '^(?:" + "|".join(x for k in X.KINDS for x in (k, k.upper())) + ")[ :.\\n]*', ''), '(?i)^V\\s*/\\s*v\\s*[:\\s]+', '')")
    + " AS subject, regexp_replace(coalesce(extraction.so_hieu, ''), '^(\\d{1,3})(20\\d{2})/(.+)$', '\\1/\\2/\\3') AS number FROM bench_labels"
)
def clean_subject(spark, d):
    return table(spark, d, "bench_labels").select("label_id", X.clean_subject(F.col("extraction.trich_yeu")).alias("subject"), X.repaired_number(F.col("extraction.so_hieu")).alias("number"))


@query()
def clean_signer(spark, d):
    return table(spark, d, "bench_labels").select("label_id", X.clean_signer(F.col("extraction.nguoi_ky")).alias("signer"))


@query("""SELECT id, CASE WHEN ok THEN json_extract_string(raw_json, '$.so_hieu') END AS so_hieu, CASE WHEN ok THEN json_extract_string(raw_json, '$.loai_van_ban') END AS loai_van_ban
    FROM (SELECT id, raw_json, raw_json IS NOT NULL AND raw_json LIKE '%{%}%' AND json_valid(raw_json) AS ok FROM extraction_results)""")
def response_fields(spark, d):
    t = table(spark, d, "extraction_results").select("id", X.response_fields(F.col("raw_json")).alias("e"))
    return t.select("id", "e.so_hieu", "e.loai_van_ban")


@query()
def reply_fields(spark, d):
    return table(spark, d, "extraction_results").select("id", U.reply_fields(F.col("raw_json")).alias("e")).select("id", "e.*")


@query()
def canonical_json_hash(spark, d):
    return table(spark, d, "extraction_results").select("id", U.canonical_hash(F.col("raw_json")).alias("sha"))


# --- layout ---------------------------------------------------------------------------------------------------------

_LINES = """SELECT label_id AS doc_id, 1 AS page, CAST(i AS INTEGER) AS line_no, lines[i] AS text, CAST(40 + (i * 37) % 300 AS INTEGER) AS x1, CAST(30 + 28 * ((i - 1) // 2) + (i % 2) * 3 AS INTEGER) AS y1
    FROM (SELECT label_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT label_id, string_split(full_text, chr(10)) AS lines FROM bench_labels WHERE full_text IS NOT NULL))"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of labels with boxes that follow from their numbers."""
    t = spread(table(spark, d, "bench_labels").where("full_text IS NOT NULL").select("label_id", "full_text")).select(F.col("label_id").alias("doc_id"), F.posexplode(F.split("full_text", "\n")).alias("i", "text"))
    i = F.col("i") + 1
    t = t.select("doc_id", F.lit(1).alias("page"), i.alias("line_no"), "text", (40 + (i * 37) % 300).cast("int").alias("x1"), (30 + 28 * F.floor((i - 1) / 2) + (i % 2) * 3).cast("int").alias("y1"))
    return t.withColumns({"x2": F.col("x1") + 200, "y2": F.col("y1") + 22})


@query(f"""WITH l AS ({_LINES}), w AS (SELECT *, CASE WHEN abs((y1 + y1 + 22) / 2.0 - lag((y1 + y1 + 22) / 2.0) OVER (PARTITION BY doc_id ORDER BY y1, line_no)) >= 11 THEN 1 ELSE 0 END AS b FROM l),
    r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY y1, line_no ROWS UNBOUNDED PRECEDING) AS row_id FROM w)
    SELECT doc_id, line_no, CAST(row_id AS BIGINT) AS row_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row_id, x1, line_no) AS INTEGER) AS reading_order FROM r""")
def reading_order(spark, d):
    return L.with_reading_order(_lines(spark, d)).select("doc_id", "line_no", F.col("row_id").cast("long").alias("row_id"), "reading_order")


def _regions(spark, d):
    t = _lines(spark, d)
    return t.withColumn("region", L.region(F.col("text"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(620), F.lit(1000)))


def _said(p: str) -> str:
    return "'" + p.replace("(?iuU)", "(?i)").replace(r"\z", "$").replace(r"\d", r"\p{Nd}").replace(r"\s", WS) + "'"


@query(f"""SELECT region, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'noi_dung' WHEN regexp_matches(t, {_said(L.SECRECY)}) THEN 'do_mat_khan'
      WHEN regexp_matches(t, {_said(L.MOTTO)}) AND cy < 0.15 THEN 'quoc_hieu' WHEN regexp_matches(t, {_said(L.NUMBER)}) AND cy < 0.22 THEN 'so_hieu'
      WHEN regexp_matches(t, {_said(L.DATE)}) AND cy < 0.22 THEN 'ngay_ban_hanh' WHEN regexp_matches(t || ' ', {_said(L.TITLE.replace(chr(92) + 'b', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]'))}) AND cy < 0.30 THEN 'ten_loai'
      WHEN regexp_matches(t || ' ', {_said(L.SUBJECT.replace(chr(92) + 'b', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]'))}) AND cy < 0.35 THEN 'trich_yeu' WHEN regexp_matches(t, {_said(L.RECEIVERS)}) AND cy > 0.65 THEN 'noi_nhan'
      WHEN regexp_matches(t, {_said(L.SIGNER)}) AND cy > 0.65 THEN 'nguoi_ky'
      WHEN cy < 0.15 THEN CASE WHEN cx > 0.40 THEN 'quoc_hieu' ELSE 'co_quan' END WHEN cy < 0.20 THEN CASE WHEN cx < 0.45 THEN 'so_hieu' ELSE 'ngay_ban_hanh' END WHEN cy < 0.28 THEN 'ten_loai'
      WHEN cy > 0.72 THEN CASE WHEN cx < 0.45 THEN 'noi_nhan' ELSE 'nguoi_ky' END ELSE 'noi_dung' END AS region
    FROM (SELECT {_strip('text')} AS t, (x1 + 100) / 620.0 AS cx, (y1 + 11) / 1000.0 AS cy FROM ({_LINES}))) GROUP BY region""")
def layout_regions(spark, d):
    return _regions(spark, d).groupBy("region").agg(F.count("*").alias("n"))


@query()
def region_texts(spark, d):
    return R.joined_lines(_regions(spark, d), ("doc_id", "region"), "line_no")


@query("""SELECT id, s.page AS page, s.x1 AS x1, s.y1 AS y1, s.confidence AS confidence, round(100.0 * s.x1 / 1000, 6) AS left_percent, round(least(greatest((s.x1 + s.x2) / 2.0 / 1000, 0.001), 0.999), 6) AS xc
    FROM (SELECT id, unnest(stamp_coordinates) AS s FROM extraction_results) WHERE s.confidence >= 0.8 AND s.x2 > s.x1 AND s.y2 > s.y1 AND (s.x2 - s.x1) / (s.y2 - s.y1)::DOUBLE BETWEEN 1 / 3.5 AND 3.5""")
def stamp_boxes(spark, d):
    """Confident stamps of sound shape with their places on the page."""
    t = table(spark, d, "extraction_results").select("id", F.explode("stamp_coordinates").alias("s")).select("id", "s.*")
    ratio = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")).cast("double")
    t = t.where((F.col("confidence") >= 0.8) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).where((ratio >= 1 / 3.5) & (ratio <= 3.5))
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")] + [F.lit(1000), F.lit(1500)]
    return t.select("id", "page", "x1", "y1", "confidence", F.round(L.percent_box(*box)["left"], 6).alias("left_percent"), F.round(L.centre_size(*box)["xc"], 6).alias("xc"))


@query("""SELECT id, page, x1, y1, area FROM (SELECT *, row_number() OVER (PARTITION BY id, page ORDER BY area DESC, x1, y1) AS r FROM
    (SELECT id, s.page AS page, s.x1 AS x1, s.y1 AS y1, CAST((s.x2 - s.x1) * (s.y2 - s.y1) AS BIGINT) AS area, s.x2 - s.x1 AS w, s.y2 - s.y1 AS h FROM (SELECT id, unnest(stamp_coordinates) AS s FROM extraction_results))
    WHERE w >= 50 AND h >= 50 AND w / h::DOUBLE BETWEEN 0.3 AND 3.0) WHERE r <= 5""")
def stamp_contours(spark, d):
    """The five largest boxes of sound shape on each page."""
    t = table(spark, d, "extraction_results").select("id", F.explode("stamp_coordinates").alias("s")).select("id", "s.*")
    t = t.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}).where("w >= 50 AND h >= 50").where(F.expr("w / double(h) BETWEEN 0.3 AND 3.0"))
    t = t.withColumn("area", (F.col("w") * F.col("h")).cast("long"))
    w = Window.partitionBy("id", "page").orderBy(F.desc("area"), "x1", "y1")
    return t.withColumn("r", F.row_number().over(w)).where("r <= 5").select("id", "page", "x1", "y1", "area")


# --- catalogue ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, filename, status FROM upload_files WHERE status = 'completed' ORDER BY created_at DESC NULLS LAST, doc_id DESC LIMIT 20 OFFSET 20")
def doc_listing_page(spark, d):
    return C.list_documents(table(spark, d, "upload_files"), "completed", 20, 20).select("doc_id", "filename", "status")


@query("SELECT count(*) AS total FROM upload_files WHERE status = 'completed'")
def doc_total(spark, d):
    return C.total(table(spark, d, "upload_files"), "completed")


@query("SELECT doc_id, filename, file_size FROM upload_files WHERE doc_id = 7")
def doc_lookup(spark, d):
    return C.get_document(table(spark, d, "upload_files"), 7).select("doc_id", "filename", "file_size")


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM extraction_results) WHERE r = 1"


@query(f"""SELECT u.doc_id AS doc_id, e.id AS id FROM upload_files u LEFT JOIN ({_LATEST}) e ON u.doc_id = e.document_id
    WHERE (contains(lower(coalesce(u.filename, '')), 'sở y tế') OR contains(lower(coalesce(e.loai_van_ban, '')), 'sở y tế') OR contains(lower(coalesce(e.so_hieu, '')), 'sở y tế') OR contains(lower(coalesce(e.co_quan_ban_hanh, '')), 'sở y tế'))
    AND u.status = 'completed' AND lower(u.file_type) = 'pdf'""")
def doc_search(spark, d):
    t = C.documents_with_extraction(table(spark, d, "upload_files"), table(spark, d, "extraction_results"))
    return C.search(t, "Sở Y tế", "completed", "pdf").select("doc_id", "id")


@query("SELECT count(*) AS all_docs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed FROM upload_files")
def doc_status_counts(spark, d):
    return C.status_counts(table(spark, d, "upload_files")).withColumnRenamed("all", "all_docs")


@query("SELECT DISTINCT lower(file_type) AS file_type FROM upload_files WHERE file_type IS NOT NULL")
def doc_facets(spark, d):
    return C.file_types(table(spark, d, "upload_files"))


@query("""SELECT doc_id, filename, coalesce(nullif(regexp_extract(file_path, '([^/\\\\]+)$', 1), ''), filename) AS storage_name, file_type, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
    strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM upload_files""")
def doc_projection(spark, d):
    return C.document_view(table(spark, d, "upload_files"))


@query(f"SELECT u.doc_id AS doc_id, u.status AS status, e.id AS id, e.so_hieu AS so_hieu, e.ocr_confidence AS ocr_confidence FROM upload_files u LEFT JOIN ({_LATEST}) e ON u.doc_id = e.document_id")
def doc_with_extraction(spark, d):
    t = C.documents_with_extraction(table(spark, d, "upload_files"), table(spark, d, "extraction_results"))
    return t.select("doc_id", "status", "id", "so_hieu", "ocr_confidence")


@query("SELECT doc_id, file_path FROM upload_files WHERE starts_with(file_path, 'data/uploads/') AND NOT regexp_matches(file_path, '(^|/)\\.\\.(/|$)')")
def path_confined(spark, d):
    return table(spark, d, "upload_files").where(C.within_root(F.col("file_path"), "data/uploads")).select("doc_id", "file_path")


@query(f"""SELECT round(avg(CASE WHEN u.status = 'completed' THEN coalesce(e.processing_time, 0) END), 1) AS avg_seconds, round(100.0 * count(*) FILTER (u.status = 'completed') / count(*), 1) AS success_percent
    FROM upload_files u LEFT JOIN ({_LATEST}) e ON u.doc_id = e.document_id""")
def dash_summary(spark, d):
    return C.dashboard(table(spark, d, "upload_files"), table(spark, d, "extraction_results"))


@query("""SELECT CAST(g.day AS INTEGER) AS day, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][g.day + 1] AS name, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / greatest(max(coalesce(c.n, 0)) OVER (), 1)::DOUBLE AS bar
    FROM range(7) g(day) LEFT JOIN (SELECT isodow(created_at) - 1 AS day, count(*) AS n FROM upload_files WHERE created_at IS NOT NULL GROUP BY 1) c ON g.day = c.day""")
def dash_weekday(spark, d):
    return C.by_weekday(table(spark, d, "upload_files"))


@query("SELECT coalesce(nullif(trim(loai_van_ban), ''), 'Other') AS kind, count(*) AS n FROM extraction_results GROUP BY 1")
def dash_type_hist(spark, d):
    return C.by_kind(table(spark, d, "extraction_results"))


@query("""SELECT u.doc_id AS doc_id, count(l.log_id) AS n_logs, count(*) FILTER (l.status = 'failed') AS n_failed FROM upload_files u LEFT JOIN processing_logs l ON u.doc_id = l.document_id GROUP BY u.doc_id""")
def doc_logs(spark, d):
    return C.log_counts(table(spark, d, "upload_files"), table(spark, d, "processing_logs"))


@query("SELECT id, document_id FROM extraction_results WHERE document_id NOT IN (SELECT doc_id FROM upload_files)")
def orphan_extractions(spark, d):
    return C.orphans(table(spark, d, "extraction_results"), "document_id", table(spark, d, "upload_files"), "doc_id").select("id", "document_id")


@query("""SELECT e.id AS id, coalesce(CASE WHEN e.id % 7 = 0 THEN 'edited ' || e.id END, e.so_hieu) AS so_hieu, e.nguoi_ky AS nguoi_ky, CASE WHEN e.id % 7 = 0 THEN true ELSE e.verified_by_user END AS verified_by_user FROM extraction_results e""")
def apply_edits(spark, d):
    e = table(spark, d, "extraction_results")
    edits = e.where("id % 7 = 0").select("id", F.concat(F.lit("edited "), F.col("id").cast("string")).alias("so_hieu"), F.lit(None).cast("string").alias("nguoi_ky"))  # every edit that was made
    return C.apply_edits(e, edits, ("so_hieu", "nguoi_ky")).select("id", "so_hieu", "nguoi_ky", "verified_by_user")


@query("""SELECT (SELECT count(*) FROM upload_files WHERE status IS DISTINCT FROM 'failed') AS n_documents, (SELECT count(*) FROM extraction_results WHERE document_id NOT IN (SELECT doc_id FROM upload_files WHERE status = 'failed')) AS n_extractions,
    (SELECT count(*) FROM processing_logs WHERE document_id NOT IN (SELECT doc_id FROM upload_files WHERE status = 'failed')) AS n_logs""")
def delete_documents(spark, d):
    u, e, l = (table(spark, d, n) for n in ("upload_files", "extraction_results", "processing_logs"))
    a, b, c = C.delete_documents(u.where("status = 'failed'").select("doc_id"), u, e, l)
    n = lambda t, name: t.agg(F.count("*").alias(name))
    return n(a, "n_documents").crossJoin(n(b, "n_extractions")).crossJoin(n(c, "n_logs"))  # three rows of one number


@query("""SELECT origin, count(*) AS n FROM (SELECT CASE WHEN edited_json IS NOT NULL AND trim(edited_json) <> '' AND json_valid(edited_json) THEN 'edited' WHEN raw_json IS NOT NULL AND trim(raw_json) <> '' AND json_valid(raw_json) THEN 'raw' ELSE 'row' END AS origin FROM extraction_results) GROUP BY origin""")
def export_origins(spark, d):
    return C.export_record(table(spark, d, "extraction_results"), M.FIELDS).groupBy("origin").agg(F.count("*").alias("n"))


@query("""SELECT stage, round(sum(duration), 4) AS seconds, max(duration) AS longest, count(duration) AS n, round(sum(duration) / sum(sum(duration)) OVER (), 6) AS share, sum(duration) = max(sum(duration)) OVER () AS slowest
    FROM processing_logs WHERE stage IS NOT NULL GROUP BY stage""")
def stage_latency(spark, d):
    t = C.stage_latency(table(spark, d, "processing_logs"))
    return t.withColumns({"seconds": F.round("seconds", 4), "share": F.round("share", 6)})


@query("""SELECT log_id, document_id FROM (SELECT *, lag(message) OVER w AS b, row_number() OVER w AS r FROM (SELECT DISTINCT * FROM processing_logs) WINDOW w AS (PARTITION BY document_id ORDER BY created_at, log_id)) WHERE r = 1 OR message IS DISTINCT FROM b""")
def log_dedupe(spark, d):
    return C.without_repeated_messages(table(spark, d, "processing_logs")).select("log_id", "document_id")


@query("""SELECT document_id, stage, status, list_position(['preprocessing', 'stamp_detection', 'ocr', 'llm', 'validation'], stage) AS step FROM
    (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, log_id DESC) AS r FROM (SELECT DISTINCT * FROM processing_logs)) WHERE r = 1""")
def latest_state(spark, d):
    return C.latest_state(table(spark, d, "processing_logs"))


# --- evaluation -----------------------------------------------------------------------------------------------------


def _long(spark: SparkSession, d: str) -> DataFrame:
    """Fields found by search against those of the labels."""
    t = table(spark, d, "bench_labels").select(F.col("label_id").alias("doc"), X.by_search(F.col("full_text")).alias("predicted"), F.col("extraction").alias("ground_truth"))
    return E.long_form(t)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Newest extractions as predictions for the documents' labels of the same number: (doc, field, predicted, ground_truth)."""
    p = C.latest_extractions(table(spark, d, "extraction_results")).select(F.col("document_id").alias("doc"), F.struct(*M.FIELDS).alias("predicted"))
    t = table(spark, d, "bench_labels").select(F.col("label_id").alias("doc"), F.col("extraction").alias("ground_truth"))
    return E.long_form(p.join(t, "doc"))


_FIELD_LIST = "[" + ", ".join(f"'{f}'" for f in M.FIELDS) + "]"
_PAIRS = f"""SELECT p.document_id AS doc, unnest({_FIELD_LIST}) AS field, unnest([{', '.join(f"coalesce(p.{f}, '')" for f in M.FIELDS)}]) AS predicted, unnest([{', '.join(f"coalesce(b.extraction.{f}, '')" for f in M.FIELDS)}]) AS ground_truth
    FROM ({_LATEST}) p JOIN bench_labels b ON p.document_id = b.label_id"""
_VALUE = lambda c: f"CASE WHEN field = 'ngay_ban_hanh' THEN coalesce({_iso('f_' + c)}, f_{c}) ELSE f_{c} END"
_METRICS = f"""SELECT doc, field, predicted, ground_truth, vp, vt, CASE WHEN sp = '' AND st = '' THEN 'both_empty' WHEN sp = '' THEN 'missed' WHEN st = '' THEN 'extra' WHEN vp = vt THEN 'correct' ELSE 'wrong' END AS status FROM
    (SELECT *, {_VALUE('p')} AS vp, {_VALUE('t')} AS vt, {_strip('predicted')} AS sp, {_strip('ground_truth')} AS st FROM (SELECT *, {_fold('predicted')} AS f_p, {_fold('ground_truth')} AS f_t FROM ({_PAIRS})))"""


@query(f"SELECT doc, field, status FROM ({_METRICS})")
def field_status(spark, d):
    return E.field_metrics(_pairs(spark, d)).select("doc", "field", "status")


@query(f"SELECT field, {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in E.STATUSES)} FROM ({_METRICS}) GROUP BY field")
def status_matrix(spark, d):
    return E.status_matrix(E.field_metrics(_pairs(spark, d)))


@query(f"""SELECT field, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS wrong, count(*) AS total, round(avg(ok::INT), 9) AS accuracy FROM (SELECT field, status IN ('correct', 'both_empty') AS ok FROM ({_METRICS})) GROUP BY field""")
def field_accuracy(spark, d):
    return E.field_accuracy(E.field_metrics(_pairs(spark, d))).withColumn("accuracy", F.round("accuracy", 9))


@query(f"SELECT count(*) FILTER (ok) AS n_correct, count(*) AS n_docs FROM (SELECT doc, bool_and(status IN ('correct', 'both_empty')) AS ok FROM ({_METRICS}) GROUP BY doc)")
def all_fields_correct(spark, d):
    return E.all_fields_correct(E.field_metrics(_pairs(spark, d)))


@query(f"""SELECT doc, round(avg((predicted = ground_truth)::INT), 9) AS strict, round(avg((vp = vt)::INT), 9) AS normalized FROM ({_METRICS}) GROUP BY doc""")
def macro_average(spark, d):
    m = E.document_macro(E.field_metrics(_pairs(spark, d)))
    return m.select("doc", F.round("strict", 9).alias("strict"), F.round("normalized", 9).alias("normalized"))


@query()
def field_means(spark, d):
    return E.field_means(E.field_metrics(_long(spark, d)))


@query(f"""SELECT field, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM
    (SELECT CASE WHEN grouping(field) = 1 THEN 'micro' ELSE field END AS field, count(*) FILTER (status = 'correct') AS tp, count(*) FILTER (status IN ('wrong', 'extra')) AS fp, count(*) FILTER (status IN ('wrong', 'missed')) AS fn
     FROM ({_METRICS}) GROUP BY GROUPING SETS ((field), ()))""")
def prf_micro(spark, d):
    t = E.prf(E.field_metrics(_pairs(spark, d)))
    return t.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"""SELECT doc, tp, fp, fn, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) END, 9) AS f1 FROM
    (SELECT doc, count(*) FILTER (hit) AS tp, count(*) FILTER (p <> '' AND t <> '' AND NOT hit) AS fp, count(*) FILTER (p = '' AND t <> '') AS fn FROM
      (SELECT doc, p, t, p <> '' AND t <> '' AND (contains(p, t) OR contains(t, p)) AS hit FROM (SELECT doc, lower({_strip('predicted')}) AS p, lower({_strip('ground_truth')}) AS t FROM ({_PAIRS}))) GROUP BY doc)""")
def legacy_f1(spark, d):
    return E.legacy_f1(_pairs(spark, d)).withColumn("f1", F.round("f1", 9))


@query()
def pooled_nonempty(spark, d):
    return E.pooled_nonempty(E.field_metrics(_pairs(spark, d)))


@query(
    "SELECT field, count(*) FILTER (filled) AS filled, count(*) AS total, round(avg(filled::INT), 9) AS rate FROM (SELECT unnest("
    + _FIELD_LIST
    + ") AS field, unnest(["
    + ", ".join(f"trim(coalesce(extraction.{f}, '')) <> ''" for f in M.FIELDS)
    + "]) AS filled FROM bench_labels) GROUP BY field"
)
def completeness(spark, d):
    return E.completeness(table(spark, d, "bench_labels")).withColumn("rate", F.round("rate", 9))


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status IS DISTINCT FROM 'completed') AS failed, round(avg((status = 'completed')::INT), 9) AS success_rate,
    round(coalesce(sum(duration) FILTER (status = 'completed'), 0), 4) AS sum_seconds, round(avg(duration) FILTER (status = 'completed'), 6) AS avg_seconds, round(median(duration) FILTER (status = 'completed'), 6) AS median_seconds,
    min(duration) FILTER (status = 'completed') AS min_seconds, max(duration) FILTER (status = 'completed') AS max_seconds FROM processing_logs""")
def run_summary(spark, d):
    t = E.run_summary(table(spark, d, "processing_logs"))
    return t.withColumns({"success_rate": F.round("success_rate", 9), "sum_seconds": F.round("sum_seconds", 4), "avg_seconds": F.round("avg_seconds", 6), "median_seconds": F.round("median_seconds", 6)})


@query("SELECT stage, CAST(list_sort(list(duration))[count(duration) // 2 + 1] AS DOUBLE) AS upper_median, round(60.0 * count(duration) / sum(duration), 6) AS per_minute FROM processing_logs WHERE duration IS NOT NULL GROUP BY stage")
def stage_throughput(spark, d):
    """The upper median and the number per minute; the durations of a stage are counted by value before they are gathered."""
    t = table(spark, d, "processing_logs").where("duration IS NOT NULL").groupBy("stage", "duration").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stage")
    t = t.withColumns({"upto": F.sum("n").over(w.orderBy("duration")), "all": F.sum("n").over(w)})
    return t.groupBy("stage").agg(F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("duration"))).alias("upper_median"), F.round(60.0 * F.sum("n") / F.sum(F.col("duration") * F.col("n")), 6).alias("per_minute"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY md5('42|' || id), id) AS i, ocr_confidence AS v FROM extraction_results WHERE ocr_confidence IS NOT NULL), n AS (SELECT count(*) AS n FROM t),
    p AS (SELECT b.b AS b, ('0x' || md5('42|' || b.b || '|' || t.i)[1:12])::BIGINT % n.n + 1 AS i FROM t, n, range(1, 101) b(b)), m AS (SELECT p.b, avg(t.v) AS m FROM p JOIN t USING (i) GROUP BY p.b)
    SELECT round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper, count(*) AS iterations FROM m""")
def bootstrap_ci(spark, d):
    t = E.bootstrap_hashed(table(spark, d, "extraction_results"), "id", "ocr_confidence", 100)
    return t.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query()
def bootstrap_exact(spark, d):
    m = E.document_macro(E.field_metrics(_pairs(spark, d)))
    return U.bootstrap_exact(m.withColumn("all", F.lit("all")), "all", "normalized", 200)


@query("SELECT n.n_name AS a, m.n_name AS b, levenshtein(n.n_name, m.n_name) AS dist, round(1 - levenshtein(n.n_name, m.n_name) / greatest(length(n.n_name), length(m.n_name))::DOUBLE, 9) AS similarity, round(levenshtein(n.n_name, m.n_name) / length(n.n_name)::DOUBLE, 9) AS cer FROM nation n JOIN nation m ON n.n_regionkey = m.n_regionkey")
def char_similarity(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    t = a.join(b, "n_regionkey")
    return t.select("a", "b", F.levenshtein("a", "b").cast("long").alias("dist"), F.round(M.char_similarity(F.col("a"), F.col("b")), 9).alias("similarity"), F.round(M.cer(F.col("a"), F.col("b")), 9).alias("cer"))


def _toks(c: str) -> str:
    return f"CASE WHEN {_ws(c)} = '' THEN []::VARCHAR[] ELSE string_split({_ws(c)}, ' ') END"


@query(f"""SELECT doc, field, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) / (len(a) + len(b)) END, 9) AS multiset,
    round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * len(list_intersect(list_distinct(a), list_distinct(b))) / (len(list_distinct(a)) + len(list_distinct(b))) END, 9) AS sets
    FROM (SELECT doc, field, {_toks('predicted')} AS a, {_toks('ground_truth')} AS b FROM ({_PAIRS}))""")
def token_f1(spark, d):
    p, t = F.col("predicted"), F.col("ground_truth")
    return _pairs(spark, d).select("doc", "field", F.round(M.token_f1(p, t), 9).alias("multiset"), F.round(M.token_f1_set(p, t), 9).alias("sets"))


@query(f"SELECT doc, field, CASE WHEN p = '' OR t = '' THEN p = '' AND t = '' ELSE contains(p, t) OR contains(t, p) END AS contained FROM (SELECT doc, field, {_strip('predicted')} AS p, {_strip('ground_truth')} AS t FROM ({_PAIRS}))")
def containment(spark, d):
    return _pairs(spark, d).select("doc", "field", M.contained(F.col("predicted"), F.col("ground_truth")).alias("contained"))


@query()
def wer(spark, d):
    t = table(spark, d, "bench_labels").where("full_text IS NOT NULL")
    return t.select("label_id", M.wer(F.col("full_text"), T.postprocess(F.col("full_text"))).alias("wer"))


@query()
def difflib_similarity(spark, d):
    return _pairs(spark, d).select("doc", "field", U.difflib_ratio(F.col("predicted"), F.col("ground_truth")).alias("ratio"))


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type")
def json_path_metric(spark, d):
    t = table(spark, d, "events").select("event_type", M.json_number(F.col("props"), "k").alias("k"))
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean_k"))


@query("SELECT count(*) AS n, count(*) FILTER (ok) AS n_valid, round(avg(ok::INT), 9) AS rate FROM (SELECT raw_json IS NOT NULL AND trim(raw_json) <> '' AND json_valid(raw_json) AS ok FROM extraction_results)")
def json_valid_rate(spark, d):
    return E.json_valid_rate(table(spark, d, "extraction_results"), "raw_json").withColumn("rate", F.round("rate", 9))


@query("SELECT total_stamps, count(*) AS n, round(avg(ocr_confidence), 6) AS mean, round(stddev_pop(ocr_confidence), 6) AS std FROM extraction_results GROUP BY total_stamps")
def confidence_stats(spark, d):
    """A24, A25."""
    return table(spark, d, "extraction_results").groupBy("total_stamps").agg(F.count("*").alias("n"), F.round(F.avg("ocr_confidence"), 6).alias("mean"), F.round(F.stddev_pop("ocr_confidence"), 6).alias("std"))


_NAMED = "SELECT id AS pred_id, regexp_replace(id, '^scan', 'bench') AS source FROM (SELECT DISTINCT id FROM manifest_entries)"


@query(f"""SELECT pred_id, seq FROM (SELECT p.pred_id AS pred_id, t.seq AS seq, row_number() OVER (PARTITION BY p.pred_id ORDER BY t.seq) AS r FROM ({_NAMED}) p JOIN
    (SELECT label_id AS seq, regexp_extract(filename, '^(.*)\\.', 1) AS source, 'bench_' || lpad(CAST(label_id + 1 AS VARCHAR), 9, '0') AS filename FROM bench_labels) t ON t.source = p.source OR t.filename = p.source) WHERE r = 1""")
def first_match_join(spark, d):
    """A disjunctive lookup as two equi-joins."""
    p = table(spark, d, "manifest_entries").select(F.col("id").alias("pred_id"), F.regexp_replace("id", "^scan", "bench").alias("source")).distinct()
    t = table(spark, d, "bench_labels").select(F.col("label_id").alias("seq"), F.regexp_extract("filename", r"^(.*)\.", 1).alias("source"), F.concat(F.lit("bench_"), F.lpad((F.col("label_id") + 1).cast("string"), 9, "0")).alias("filename"), F.lit("").alias("truth"))
    return E.first_match(p, t).select("pred_id", "seq")


@query("SELECT document_id, so_hieu FROM (SELECT document_id, so_hieu, row_number() OVER (PARTITION BY document_id ORDER BY id DESC) AS r FROM extraction_results) WHERE r = 1")
def merge_override(spark, d):
    return E.merged_truth(table(spark, d, "extraction_results"), "document_id", "id").select("document_id", "so_hieu")


# --- governance -----------------------------------------------------------------------------------------------------


@query("SELECT label_id, sha256(full_text) AS sha, length(full_text) AS n FROM bench_labels WHERE full_text IS NOT NULL")
def text_hash(spark, d):
    return table(spark, d, "bench_labels").where("full_text IS NOT NULL").select("label_id", G.sha256(F.col("full_text")).alias("sha"), F.length("full_text").cast("long").alias("n"))


@query(f"""SELECT sha, string_agg(split, ',' ORDER BY split) AS splits, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lower(input_sha256) AS sha, lower({_strip('split')}) AS split, count(*) AS n FROM manifest_entries WHERE input_sha256 IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2) GROUP BY sha HAVING count(*) > 1""")
def leakage_exact(spark, d):
    return G.split_leakage(table(spark, d, "manifest_entries"))


@query("SELECT id, count(*) AS n FROM manifest_entries WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return G.duplicates(table(spark, d, "manifest_entries"), "id")


@query("""WITH a AS (SELECT DISTINCT id AS stem FROM manifest_entries WHERE id IS NOT NULL), b AS (SELECT DISTINCT regexp_extract(filename, '^(.*)\\.', 1) AS stem FROM bench_labels)
    SELECT stem, 'left' AS side FROM a WHERE stem NOT IN (SELECT stem FROM b) UNION ALL SELECT stem, 'right' FROM b WHERE stem NOT IN (SELECT stem FROM a)""")
def pair_audit(spark, d):
    a = table(spark, d, "manifest_entries").select(F.col("id").alias("stem"))
    b = table(spark, d, "bench_labels").select(F.regexp_extract("filename", r"^(.*)\.", 1).alias("stem"))
    return G.unpaired(a, b, "stem")


@query("""SELECT * FROM (SELECT 'missing id' AS rule, count(*) FILTER (trim(coalesce(id, '')) = '') AS n FROM manifest_entries UNION ALL SELECT 'missing input_path', count(*) FILTER (trim(coalesce(input_path, '')) = '') FROM manifest_entries
    UNION ALL SELECT 'missing input_sha256', count(*) FILTER (trim(coalesce(input_sha256, '')) = '') FROM manifest_entries)""")
def manifest_required(spark, d):
    return G.required_missing(table(spark, d, "manifest_entries"))


@query("""SELECT rule, count(*) AS n FROM (SELECT 'no split' AS rule FROM manifest_entries WHERE trim(coalesce(split, '')) = '' UNION ALL SELECT 'no source type' FROM manifest_entries WHERE trim(coalesce(source_type, '')) = ''
    UNION ALL SELECT 'label without hash' FROM manifest_entries WHERE trim(coalesce(label_path, '')) <> '' AND trim(coalesce(label_sha256, '')) = '' UNION ALL SELECT 'hash of odd length' FROM manifest_entries WHERE trim(coalesce(input_sha256, '')) <> '' AND length(input_sha256) <> 64
    UNION ALL SELECT 'duplicate id' FROM (SELECT id FROM (SELECT DISTINCT * FROM manifest_entries) WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)) GROUP BY rule""")
def manifest_rules(spark, d):
    return G.manifest_rules(table(spark, d, "manifest_entries")).groupBy("rule").agg(F.count("*").alias("n"))


_HASHES = "SELECT path, min(sha) AS sha FROM (SELECT input_path AS path, lower(input_sha256) AS sha FROM manifest_entries WHERE input_sha256 IS NOT NULL AND length(input_path) % 7 <> 0) GROUP BY path"


@query(f"""SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN i.sha IS NULL THEN 'missing input' WHEN i.sha <> lower(e.input_sha256) THEN 'input hash mismatch' END, CASE WHEN e.label_path IS NULL THEN 'missing label_path' WHEN l.sha IS NULL THEN 'missing label' WHEN l.sha <> lower(e.label_sha256) THEN 'label hash mismatch' END]) AS problem
    FROM (SELECT DISTINCT * FROM manifest_entries) e LEFT JOIN ({_HASHES}) i ON e.input_path = i.path LEFT JOIN ({_HASHES}) l ON e.label_path = l.path) WHERE problem IS NOT NULL GROUP BY problem""")
def manifest_hash_problems(spark, d):
    """Q4: the manifest against the files there are, those of the smallest hash of each input path but for some lengths of paths."""
    e = table(spark, d, "manifest_entries").dropDuplicates()
    files = e.where("input_sha256 IS NOT NULL AND length(input_path) % 7 <> 0").groupBy(F.col("input_path").alias("path")).agg(F.min(F.lower("input_sha256")).alias("sha256"))
    return G.hash_problems(e, files).groupBy("problem").agg(F.count("*").alias("n"))


@query()
def label_contract(spark, d):
    return G.label_contract(table(spark, d, "bench_labels")).groupBy("rule").agg(F.count("*").alias("n"))


# --- data sets ------------------------------------------------------------------------------------------------------

_BUCKET = lambda key, n, seed=42: f"CAST(('0x' || md5('{seed}|' || {key})[1:12])::BIGINT % {n} AS INTEGER)"


@query(f"SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN {_BUCKET('doc_id', 100)} < 80 THEN 'train' WHEN {_BUCKET('doc_id', 100)} < 90 THEN 'val' ELSE 'test' END AS split FROM documents) GROUP BY split")
def split_hash(spark, d):
    t = table(spark, d, "documents").withColumn("split", S.split(F.col("doc_id")))
    return t.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN r <= floor(c * 0.8) THEN 'train' WHEN r <= floor(c * 0.9) THEN 'val' ELSE 'test' END AS split FROM
    (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER () AS c FROM documents)) GROUP BY split""")
def split_exact(spark, d):
    return S.split_exact(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, d):
    return S.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query(f"SELECT source, count(*) FILTER (length({_strip('coalesce(text, chr(39)[0:0])')}) >= 50) AS n_long FROM documents GROUP BY source")
def long_enough(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(S.long_enough(F.col("text"), 50)).alias("n_long"))


@query("""SELECT label_id, 'classify' AS task, coalesce(extraction.loai_van_ban, '') AS output FROM bench_labels UNION ALL SELECT label_id, 'extract', NULL FROM bench_labels""")
def task_rows(spark, d):
    t = S.task_rows(table(spark, d, "bench_labels"), "label_id", "full_text", "extraction.loai_van_ban")
    return t.select("label_id", "task", F.when(F.col("task") == "classify", F.col("output")).alias("output"))


@query(f"""SELECT label_id, CASE WHEN hit AND w = 0 THEN '' ELSE extraction.so_hieu END AS so_hieu, CASE WHEN hit AND w = 1 THEN '' ELSE extraction.nguoi_ky END AS nguoi_ky FROM (SELECT label_id, extraction, {_BUCKET('label_id', 100)} < 10 AS hit, {_BUCKET('label_id', 2, 43)} AS w FROM bench_labels)""")
def drop_fields(spark, d):
    t = table(spark, d, "bench_labels").select("label_id", S.drop_fields(F.col("extraction"), F.col("label_id"), ("so_hieu", "nguoi_ky")).alias("e"))
    return t.select("label_id", "e.so_hieu", "e.nguoi_ky")


@query(f"""SELECT doc_id, (b1 + 1) || '/' || ['QĐ', 'TB', 'CV', 'KH'][b2 + 1] || '-UBND' AS number, printf('%02d/%02d/%d', b3 + 1, b4 + 1, b5 + 2019) AS date FROM
    (SELECT doc_id, {_BUCKET('doc_id', 4999)} AS b1, {_BUCKET('doc_id', 4, 43)} AS b2, {_BUCKET('doc_id', 28)} AS b3, {_BUCKET('doc_id', 12, 43)} AS b4, {_BUCKET('doc_id', 6, 44)} AS b5 FROM documents)""")
def made_up_metadata(spark, d):
    return table(spark, d, "documents").select("doc_id", S.made_up_number(F.col("doc_id")).alias("number"), S.made_up_date(F.col("doc_id")).alias("date"))


@query()
def composed_documents(spark, d):
    t = table(spark, d, "bench_labels")
    clean = t.select("label_id", S.composed_document(F.col("extraction"), T.text(F.col("full_text"))).alias("text"), F.lit("clean").alias("variant"))
    noisy = clean.withColumns({"text": T.scan_noise(F.col("text"), F.col("label_id")), "variant": F.lit("noisy")})
    return clean.unionByName(noisy)


@query("""SELECT label_id, '### Instruction:' || chr(10) || 'Trích xuất.' || chr(10) || chr(10) || '### Input:' || chr(10) || coalesce(full_text, '') || chr(10) || chr(10) || '### Response:' || chr(10) || coalesce(extraction.so_hieu, '') || '</s>' AS row_text FROM bench_labels""")
def training_text(spark, d):
    """C9 with the whole input."""
    return table(spark, d, "bench_labels").select("label_id", S.training_text(F.lit("Trích xuất."), F.col("full_text"), F.col("extraction.so_hieu")).alias("row_text"))


@query()
def conversations(spark, d):
    return table(spark, d, "bench_labels").select("label_id", S.conversation(F.col("label_id"), F.lit("Số hiệu?"), T.text(F.col("extraction.so_hieu"))).alias("json"))


# --- retrieval ------------------------------------------------------------------------------------------------------


@query()
def chunk_paragraphs(spark, d):
    return R.chunk_rows(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query()
def chunk_paragraphs_whole(spark, d):
    """The other overlap rule."""
    t = table(spark, d, "bench_labels").where("full_text IS NOT NULL")
    return t.select("label_id", F.posexplode(R.paragraph_chunks(F.col("full_text"), 3000, 500, True)).alias("i", "text"))


_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _first_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"]


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), vec_id LIMIT 10")
def cosine_topk(spark, d):
    t = R.nearest(table(spark, d, "embeddings"), _first_vector(spark, d), 10)
    return t.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), 6) AS distance FROM embeddings WHERE label = 1 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), vec_id LIMIT 5")
def cosine_topk_filtered(spark, d):
    t = R.nearest(table(spark, d, "embeddings"), _first_vector(spark, d), 5, F.col("label") == 1)
    return t.select("vec_id", F.round("distance", 6).alias("distance"))


def _all_sql(k: int, where: str) -> str:
    d = "1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
    return f"""SELECT query_id, vec_id, round(distance, 6) AS distance FROM (SELECT q.vec_id AS query_id, v.vec_id, {d} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.{where})
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {k}"""


def _nearest_all(spark, d, k: int, where=None) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query against all."""
    t = table(spark, d, "embeddings")
    return R.nearest_each(t, t.where("vec_id % 20 = 0"), k, where)


@query(_all_sql(10, "vec_id IS NOT NULL"))
def cosine_topk_all(spark, d):
    return _nearest_all(spark, d, 10).withColumn("distance", F.round("distance", 6))


@query(_all_sql(5, "label = 1"))
def cosine_topk_filtered_all(spark, d):
    return _nearest_all(spark, d, 5, F.col("label") == 1).withColumn("distance", F.round("distance", 6))


@query("SELECT label_id, line_no, regexp_replace(text || chr(10) || '[Đoạn ' || line_no || '/' || n || ']', '', '') AS marked FROM (SELECT doc_id AS label_id, line_no, text, count(*) OVER (PARTITION BY doc_id) AS n FROM (" + _LINES + "))")
def annotated_chunks(spark, d):
    """G7 of every line, taken as a chunk."""
    t = table(spark, d, "bench_labels").where("full_text IS NOT NULL").select("label_id", F.split("full_text", "\n").alias("l"))
    t = t.select("label_id", F.size("l").alias("n"), F.posexplode("l").alias("i", "text"))
    return t.select("label_id", (F.col("i") + 1).alias("line_no"), R.annotated(F.col("text"), F.col("i"), F.col("n")).alias("marked"))


@query()
def annotated_chunks_whole(spark, d):
    """G7 of every chunk of every text."""
    t = R.chunk_rows(table(spark, d, "documents"), "doc_id", "text")
    return t.select("chunk_id", "doc_id", "chunk_index", R.annotated(F.col("text"), F.col("chunk_index"), F.col("total_chunks")).alias("marked"))


@query("""SELECT document_id, min_by(so_hieu, id) FILTER (trim(coalesce(so_hieu, '')) <> '') AS so_hieu, min_by(nguoi_ky, id) FILTER (trim(coalesce(nguoi_ky, '')) <> '') AS nguoi_ky FROM extraction_results GROUP BY document_id""")
def merge_chunks(spark, d):
    return R.merged_chunk_results(table(spark, d, "extraction_results"), ("so_hieu", "nguoi_ky"), key="document_id", order="id")


@query(f"""WITH v AS (SELECT label_id AS doc_id, lower({_strip('extraction.trich_yeu')}) AS v FROM bench_labels WHERE extraction.trich_yeu IS NOT NULL), l AS (SELECT doc_id, line_no, lower({_strip('text')}) AS l FROM ({_LINES}))
    SELECT doc_id, count(*) AS n_lines, CAST(min(line_no) AS INTEGER) AS first_line FROM (SELECT v.doc_id, line_no, v, l, list_filter(regexp_split_to_array(v, '{WS}+'), lambda w: length(w) > 2) AS ws FROM v JOIN l USING (doc_id))
    WHERE v <> '' AND l <> '' AND (contains(v, l) OR contains(l, v) OR (len(ws) > 0 AND len(list_filter(ws, lambda w: contains(l, w))) / len(ws)::DOUBLE >= 0.5)) GROUP BY doc_id""")
def evidence_theta_join(spark, d):
    t = spread(table(spark, d, "bench_labels").where("extraction.trich_yeu IS NOT NULL AND full_text IS NOT NULL").select("label_id", F.col("extraction.trich_yeu").alias("value"), "full_text"))
    t = t.select(F.col("label_id").alias("doc_id"), "value", F.posexplode(F.split("full_text", "\n")).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    t = t.where(R.supports(F.col("value"), F.col("line")))  # value and lines come from one row, so there is nothing to join
    return t.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


@query("""WITH c AS (SELECT doc_id, line_no FROM (""" + _LINES + """) WHERE regexp_matches(text, '^Điều')), g AS (SELECT doc_id, line_no, sum(CASE WHEN line_no - p > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM (SELECT *, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM c)),
    r AS (SELECT doc_id, g, min(line_no) AS first, max(line_no) AS last, count(*) AS n FROM g GROUP BY doc_id, g) SELECT doc_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM r) WHERE k = 1""")
def line_islands(spark, d):
    return R.islands(_lines(spark, d).where(F.col("text").rlike("^Điều")), "doc_id", "line_no")


@query()
def context_listagg(spark, d):
    e = R.nearest(table(spark, d, "embeddings"), _first_vector(spark, d), 5).select(F.col("vec_id").alias("doc_id"), "distance")
    return R.context(e.join(table(spark, d, "documents"), "doc_id"))


@query()
def context_listagg_all(spark, d):
    """context_listagg for each query of cosine_topk_all."""
    e = _nearest_all(spark, d, 5).withColumnRenamed("vec_id", "doc_id")
    return R.contexts(e.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "left"))


# --- streams and windows of time ------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', created_at) AS window_start, stage, count(*) AS n, round(sum(duration), 4) AS seconds FROM processing_logs GROUP BY 1, 2")
def stage_windows(spark, d):
    t = LOGS.stage_windows(table(spark, d, "processing_logs").where("created_at IS NOT NULL"))
    return t.withColumn("seconds", F.round("seconds", 4))


@query("SELECT date_trunc('day', created_at) AS window_start, stage, count(*) AS n, round(sum(duration), 4) AS seconds FROM processing_logs GROUP BY 1, 2")
def stage_windows_stream(spark, d):
    """The same as a stream over the log files, its complete result after the last batch."""
    at = shared_folder(spark, "stream")
    s = LOGS.read_logs(spark, f"{d.rstrip('/')}/processing_logs.parquet")
    return LOGS.run_to_table(LOGS.stage_windows(s), f"{at}/out", f"{at}/checkpoint", "complete").withColumn("seconds", F.round("seconds", 4))


@query()
def log_sessions(spark, d):
    return LOGS.sessions(LOGS.once(table(spark, d, "processing_logs")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    t = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return t.select("w.start", "event_type", "n", "total").withColumnRenamed("start", "window_start")


@query("""SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, g""")
def events_session(spark, d):
    t = table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return t.select("user_id", "first_ts", "n")


# --- beyond the reference: star-schema queries ------------------------------------------------------------------------


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def cube_lang_source(spark, d):
    return table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def tpch_q1(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def tpch_q3(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))
    t = c.join(o, c["c_custkey"] == o["o_custkey"]).join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    return t.groupBy("l_orderkey").agg(F.round(F.sum("p"), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark, d):
    t = table(spark, d, "lineitem").where("l_discount BETWEEN double(0.05) AND double(0.07) AND l_quantity < 24")
    return t.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


from . import folders, pages  # noqa: E402, F401  (they add their queries)

"""Queries on pages, regions, dates and measures, with their SQL."""

from __future__ import annotations

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
from ..operators import retrieval as R
from ..session import table
from .catalogue import _BUCKET, _LINES, _METRICS, _PAIRS, _QUERY, ORACLE, _lines, _pairs, _said, _strip, _toks, _ws, query

_SIZE = (620, 1000)  # of the pages the lines stand on
_BOUND = lambda p: _said(p.replace("\\b", "[^\\p{L}\\p{N}_]"))
_REGION_LINES = f"""SELECT doc_id, page, line_no, text, CASE WHEN t = '' THEN 'noi_dung' WHEN regexp_matches(t, {_said(L.SECRECY)}) THEN 'do_mat_khan'
      WHEN regexp_matches(t, {_said(L.MOTTO)}) AND cy < 0.15 THEN 'quoc_hieu' WHEN regexp_matches(t, {_said(L.NUMBER)}) AND cy < 0.22 THEN 'so_hieu'
      WHEN regexp_matches(t, {_said(L.DATE)}) AND cy < 0.22 THEN 'ngay_ban_hanh' WHEN regexp_matches(t || ' ', {_BOUND(L.TITLE)}) AND cy < 0.30 THEN 'ten_loai'
      WHEN regexp_matches(t || ' ', {_BOUND(L.SUBJECT)}) AND cy < 0.35 THEN 'trich_yeu' WHEN regexp_matches(t, {_said(L.RECEIVERS)}) AND cy > 0.65 THEN 'noi_nhan'
      WHEN regexp_matches(t, {_said(L.SIGNER)}) AND cy > 0.65 THEN 'nguoi_ky'
      WHEN cy < 0.15 THEN CASE WHEN cx > 0.40 THEN 'quoc_hieu' ELSE 'co_quan' END WHEN cy < 0.20 THEN CASE WHEN cx < 0.45 THEN 'so_hieu' ELSE 'ngay_ban_hanh' END WHEN cy < 0.28 THEN 'ten_loai'
      WHEN cy > 0.72 THEN CASE WHEN cx < 0.45 THEN 'noi_nhan' ELSE 'nguoi_ky' END ELSE 'noi_dung' END AS region
    FROM (SELECT *, {_strip('text')} AS t, (x1 + 100) / 620.0 AS cx, (y1 + 11) / 1000.0 AS cy FROM ({_LINES}))"""
_CASE = lambda i: "CASE region " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in L.REGIONS.items()) + " END"


def _classified(spark, d):
    return L.classified(_lines(spark, d), *map(F.lit, _SIZE))


@query(f"SELECT region, {_CASE(0)} AS region_id, {_CASE(1)} AS region_name, count(*) AS n FROM ({_REGION_LINES}) GROUP BY ALL")
def classified_pages(spark, d):
    """L2, J10, J12."""
    return _classified(spark, d).groupBy("region", "region_id", "region_name").agg(F.count("*").alias("n"))


_FIELD_TEXTS = ", ".join(f"{_strip(f'''coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (region = '{k}'), '')''')} AS {k}_text" for k in L.FIELD_REGIONS)


@query(f"SELECT doc_id, page, {', '.join(f'md5({k}_text) AS {k}' for k in L.FIELD_REGIONS)} FROM (SELECT doc_id, page, {_FIELD_TEXTS} FROM ({_REGION_LINES}) GROUP BY doc_id, page)")
def region_fields(spark, d):
    """L3: the nine texts of each page, as digests."""
    t = L.region_fields(_classified(spark, d))
    return t.select("doc_id", "page", *[F.md5(f"{k}_text").alias(k) for k in L.FIELD_REGIONS])


@query(f"SELECT doc_id, region, md5(string_agg(text, chr(10) ORDER BY line_no)) AS h FROM ({_REGION_LINES}) GROUP BY doc_id, region")
def region_text_digests(spark, d):
    """region_texts as digests, which SQL has too."""
    return R.joined_lines(_classified(spark, d), ("doc_id", "region"), "line_no").select("doc_id", "region", F.md5("text").alias("h"))


@query(f"""SELECT doc_id, CASE WHEN agency <> '' THEN agency ELSE array_to_string(list_filter(list_transform(string_split(block, chr(10)), lambda x: {_strip('x')}), lambda x: NOT regexp_matches(x, '^\\d+[\\\\/]') AND x <> ''), ' ') END AS agency
    FROM (SELECT r.doc_id, coalesce(nullif(b.extraction.co_quan_ban_hanh, NULL), '') AS agency, r.block FROM (SELECT doc_id, {_strip("coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (region = 'co_quan'), '')")} AS block FROM ({_REGION_LINES}) GROUP BY doc_id) r JOIN bench_labels b ON b.label_id = r.doc_id)""")
def agency_from_layout(spark, d):
    """A missing agency from the lines of its region."""
    t = L.region_fields(_classified(spark, d)).join(table(spark, d, "bench_labels").select(F.col("label_id").alias("doc_id"), F.col("extraction.co_quan_ban_hanh").alias("a")), "doc_id")
    return t.select("doc_id", X.agency_from_block(T.text(F.col("a")), F.col("co_quan_text")).alias("agency"))


@query()
def subject_from_layout(spark, d):
    """The lines after the title where they say more than the subject."""
    t = L.region_fields(_classified(spark, d)).join(table(spark, d, "bench_labels").select(F.col("label_id").alias("doc_id"), F.col("extraction.trich_yeu").alias("s")), "doc_id")
    return t.select("doc_id", X.longer_subject(F.col("s"), F.col("ten_loai_text")).alias("subject"))


@query("SELECT id, s.page AS page, least(s.x1, s.x2) AS x1, least(s.y1, s.y2) AS y1, greatest(s.x1, s.x2) AS x2, greatest(s.y1, s.y2) AS y2 FROM (SELECT id, unnest(stamp_coordinates) AS s FROM extraction_results)")
def quad_boxes(spark, d):
    """L4: boxes around the four corners of stamps."""
    t = table(spark, d, "extraction_results").select("id", F.explode("stamp_coordinates").alias("s"))
    corner = lambda x, y: F.array(F.col(f"s.{x}"), F.col(f"s.{y}"))
    quad = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    return t.select("id", "s.page", L.axis_box(quad).alias("b")).select("id", "page", "b.*")


@query("""SELECT id, page, strong, greatest(0, x1 - 10) AS x1, greatest(0, y1 - 10) AS y1, least(600, x2 + 10) AS x2, least(900, y2 + 10) AS y2 FROM
    (SELECT id, s.page AS page, s.confidence >= 0.5 AS strong, s.x1 AS x1, s.y1 AS y1, s.x2 AS x2, s.y2 AS y2 FROM (SELECT id, unnest(stamp_coordinates) AS s FROM extraction_results) WHERE s.confidence >= 0.25)
    WHERE least(600, x2 + 10) > greatest(0, x1 - 10) AND least(900, y2 + 10) > greatest(0, y1 - 10)""")
def padded_stamps(spark, d):
    """Stamps from both thresholds on, padded, kept within a page of 600 by 900, without those that lie beyond it."""
    t = table(spark, d, "extraction_results").select("id", F.explode("stamp_coordinates").alias("s")).where("s.confidence >= 0.25")
    box = L.clamped(*[F.col(f"s.{c}") for c in ("x1", "y1", "x2", "y2")], F.lit(600), F.lit(900), 10)
    return t.select("id", "s.page", (F.col("s.confidence") >= 0.5).alias("strong"), box.alias("b")).where("b.x2 > b.x1 AND b.y2 > b.y1").select("id", "page", "strong", "b.*")


@query("""SELECT doc_id, CAST(CASE WHEN len(a) < 3 AND len(b) > len(a) THEN len(b) ELSE len(a) END AS BIGINT) AS n, len(a) < 3 AND len(b) > len(a) AS second FROM
    (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 60) AS a, string_split(text, chr(10)) AS b FROM documents WHERE text IS NOT NULL)""")
def engine_choice(spark, d):
    """The long lines as one engine's reading, all lines as the other's."""
    lines = F.split("text", "\n")
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.filter(lines, lambda x: F.length(x) > 60).alias("a"), lines.alias("b"))
    return t.select("doc_id", F.size(L.fuller_reading(F.col("a"), F.col("b"))).cast("long").alias("n"), ((F.size("a") < 3) & (F.size("b") > F.size("a"))).alias("second"))


@query("SELECT label_id, CAST(i AS INTEGER) AS page, md5(p[i]) AS h FROM (SELECT label_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT label_id, string_split(full_text, chr(10) || chr(10)) AS p FROM bench_labels WHERE full_text IS NOT NULL))")
def page_numbers(spark, d):
    """Blank lines as ends of pages."""
    return C.page_texts(table(spark, d, "bench_labels").where("full_text IS NOT NULL"), "label_id", "full_text", "\n\n").select("label_id", "page", F.md5("text").alias("h"))


@query("SELECT id, document_id, loai_van_ban, so_hieu, ngay_ban_hanh, co_quan_ban_hanh, trich_yeu, nguoi_ky, ocr_confidence, llm_confidence, total_stamps, len(stamp_coordinates) AS n_boxes, processing_time, verified_by_user, raw_json, edited_json FROM extraction_results")
def extraction_view(spark, d):
    """F6, all columns; of the boxes their number."""
    t = C.extraction_view(table(spark, d, "extraction_results"))
    return t.withColumn("n_boxes", F.when(F.col("stamp_coordinates").isNotNull(), F.size("stamp_coordinates"))).drop("stamp_coordinates")


# --- dates and texts ------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)ngày\\s+(\\d{1,2}[/\\-.]\\d{1,2}[/\\-.]\\d{4})', 1), ''),
      CASE WHEN regexp_matches(text, '[Nn]gày\\s+\\d{1,2}\\s+tháng\\s+\\d{1,2}\\s+năm\\s+\\d{4}') THEN regexp_extract(text, '[Nn]gày\\s+(\\d{1,2})\\s+tháng\\s+(\\d{1,2})\\s+năm\\s+(\\d{4})', 1) || '/' || regexp_extract(text, '[Nn]gày\\s+(\\d{1,2})\\s+tháng\\s+(\\d{1,2})\\s+năm\\s+(\\d{4})', 2) || '/' || regexp_extract(text, '[Nn]gày\\s+(\\d{1,2})\\s+tháng\\s+(\\d{1,2})\\s+năm\\s+(\\d{4})', 3) END,
      regexp_extract(array_to_string(string_split(text, chr(10))[1:20], chr(10)), '(\\d{1,2}/\\d{1,2}/\\d{4})', 1)) AS date FROM documents WHERE text IS NOT NULL""".replace("\\s", "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]").replace("\\d", "\\p{Nd}"))
def label_dates(spark, d):
    """D8."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", D.label_date(F.col("text")).alias("date"))


@query("SELECT doc_id, strftime(created_at, '%a') AS day FROM upload_files")
def created_weekday(spark, d):
    """D7."""
    return table(spark, d, "upload_files").select("doc_id", D.weekday_name(F.col("created_at")).alias("day"))


def _cut(c: str) -> str:
    for p in ("số: ", "số:", "ngày ", "v/v "):
        c = f"list_transform([{c}], lambda z: CASE WHEN starts_with(z, '{p}') THEN z[{len(p) + 1}:] ELSE z END)[1]"
    return f"replace({c}, '  ', ' ')"


_LOW = _strip("coalesce(extraction.so_hieu, '')")


@query(f"SELECT label_id, {_ws('lower(extraction.co_quan_ban_hanh)')} AS simple, {_cut(f'lower({_LOW})')} AS cut FROM bench_labels")
def older_normals(spark, d):
    """N12."""
    return table(spark, d, "bench_labels").select("label_id", T.simple_normal(F.col("extraction.co_quan_ban_hanh")).alias("simple"), T.prefix_normal(F.col("extraction.so_hieu")).alias("cut"))


@query()
def body_marked(spark, d):
    """N15."""
    return table(spark, d, "bench_labels").where("full_text IS NOT NULL").select("label_id", T.body_markers(F.col("full_text")).alias("text"))


@query("SELECT label_id, array_to_string(list_transform(string_split(extraction.nguoi_ky, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS titled FROM bench_labels")
def title_names(spark, d):
    """N18."""
    return table(spark, d, "bench_labels").select("label_id", T.title_case(F.col("extraction.nguoi_ky")).alias("titled"))


@query("SELECT doc_id, coalesce(list_extract(m, 1), '') AS first, coalesce(list_extract(m, -1), '') AS last FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') AS m FROM documents WHERE text IS NOT NULL)")
def first_and_last_match(spark, d):
    """O7."""
    m = F.regexp_extract_all("text", F.lit("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), F.lit(0))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *[F.coalesce(F.try_element_at(m, F.lit(i)), F.lit("")).alias(n) for n, i in (("first", 1), ("last", -1))])


# --- measures -------------------------------------------------------------------------------------------------------


def _mapped(a: str, b: str, v: str) -> str:
    """The edit distance of two lists in DuckDB, whose levenshtein counts bytes: each member is one ASCII character."""
    one = lambda x: f"array_to_string(list_transform({x}, lambda z: chr(33 + list_position({v}, z)::INT)), '')"
    return f"levenshtein({one(a)}, {one(b)})"


_CHARS = lambda c: f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE regexp_extract_all({c}, '(?s).') END"
_NUMBERS = f"SELECT * FROM ({_PAIRS}) WHERE field IN ('so_hieu', 'loai_van_ban', 'nguoi_ky')"
_RATES = f"""SELECT doc, field, CASE WHEN len(tc) = 0 THEN CASE WHEN len(pc) = 0 THEN 0 ELSE 1 END ELSE {_mapped('tc', 'pc', 'vc')} / len(tc)::DOUBLE END AS cer, CASE WHEN len(tw) = 0 THEN CASE WHEN len(pw) = 0 THEN 0 ELSE 1 END ELSE {_mapped('tw', 'pw', 'vw')} / len(tw)::DOUBLE END AS wer FROM
    (SELECT *, list_distinct(pc || tc) AS vc, list_distinct(pw || tw) AS vw FROM (SELECT doc, field, {_CHARS('predicted')} AS pc, {_CHARS('ground_truth')} AS tc, {_toks('predicted')} AS pw, {_toks('ground_truth')} AS tw FROM ({_NUMBERS})))"""


def _rates(spark, d):
    p, t = F.col("predicted"), F.col("ground_truth")
    return _pairs(spark, d).where("field IN ('so_hieu', 'loai_van_ban', 'nguoi_ky')").select("doc", "field", M.cer(t, p).alias("cer"), M.wer(t, p).alias("wer"))


@query(f"SELECT doc, field, round(cer, 9) AS cer, round(wer, 9) AS wer FROM ({_RATES})")
def field_error_rates(spark, d):
    """M7, M8."""
    return _rates(spark, d).select("doc", "field", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))


@query(f"SELECT field, round(avg(cer), 6) AS cer_mean, round(stddev_pop(cer), 6) AS cer_std, round(avg(wer), 6) AS wer_mean, round(stddev_pop(wer), 6) AS wer_std, count(*) AS n FROM ({_RATES}) GROUP BY field")
def error_rates(spark, d):
    """A24."""
    t = E.error_rates(_rates(spark, d), ("field",))
    return t.select("field", "n", *[F.round(c, 6).alias(c) for c in ("cer_mean", "cer_std", "wer_mean", "wer_std")])


@query(f"""SELECT doc, field, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE END, 9) AS similarity
    FROM (SELECT doc, field, list_distinct({_CHARS('predicted')}) AS a, list_distinct({_CHARS('ground_truth')}) AS b FROM ({_PAIRS}))""")
def char_set_similarity(spark, d):
    """M6."""
    return _pairs(spark, d).select("doc", "field", F.round(M.char_set_similarity(F.col("predicted"), F.col("ground_truth")), 9).alias("similarity"))


@query("SELECT stage, round(1 / avg(duration), 9) AS per_second FROM processing_logs WHERE duration IS NOT NULL GROUP BY stage")
def stage_rate(spark, d):
    """M16."""
    return table(spark, d, "processing_logs").where("duration IS NOT NULL").groupBy("stage").agg(F.round(M.throughput(F.col("duration")), 9).alias("per_second"))


@query(f"""SELECT field, round(2 * p * r / (p + r + 1e-9), 9) AS f1 FROM (SELECT field, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM
    (SELECT field, count(*) FILTER (status = 'correct')::DOUBLE AS tp, count(*) FILTER (status IN ('wrong', 'extra')) AS fp, count(*) FILTER (status IN ('wrong', 'missed')) AS fn FROM ({_METRICS}) GROUP BY field))""")
def epsilon_f1(spark, d):
    """A17."""
    t = E.prf(E.field_metrics(_pairs(spark, d))).where("field <> 'micro'")
    return t.select("field", F.round(M.f1_epsilon(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("f1"))


_SIM = f"CASE WHEN len(pc) = 0 AND len(tc) = 0 THEN 1 WHEN len(pc) = 0 OR len(tc) = 0 THEN 0 ELSE greatest(0, 1 - {_mapped('pc', 'tc', 'list_distinct(pc || tc)')} / greatest(len(pc), len(tc))::DOUBLE) END"
_TOKEN = "CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) / (len(a) + len(b)) END"
_SCORED = f"""SELECT field, ground_truth, (predicted = ground_truth)::INT AS strict, (vp = vt)::INT AS normalized, {_SIM} AS similarity, {_TOKEN} AS token_f1
    FROM (SELECT *, {_CHARS('vp')} AS pc, {_CHARS('vt')} AS tc, {_toks('vp')} AS a, {_toks('vt')} AS b FROM ({_METRICS}))"""
_MEANS = ", ".join(f"round(avg({s}), 6) AS {s}" for s in ("strict", "normalized", "token_f1", "similarity"))


@query(f"SELECT field, {_MEANS} FROM ({_SCORED}) GROUP BY field")
def field_score_means(spark, d):
    """A13 of stored extractions: means of the measures per field."""
    t = E.field_means(E.field_metrics(_pairs(spark, d)))
    return t.select("field", *[F.round(s, 6).alias(s) for s in ("strict", "normalized", "token_f1", "similarity")])


@query(f"SELECT CASE WHEN grouping(field) = 1 THEN 'pooled' ELSE field END AS field, {', '.join(f'round(avg({s}), 6) AS {s}' for s in ('normalized', 'similarity', 'token_f1'))} FROM ({_SCORED}) WHERE trim(ground_truth) <> '' GROUP BY GROUPING SETS ((field), ())")
def filled_score_means(spark, d):
    """A18 with rounded means, which SQL has too."""
    t = E.pooled_nonempty(E.field_metrics(_pairs(spark, d)))
    return t.select("field", *[F.round(s, 6).alias(s) for s in ("normalized", "similarity", "token_f1")])


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i]))) / len(a), 6) AS mse, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 4) AS sad,
    round(CASE WHEN u = 0 THEN 1 ELSE c / u::DOUBLE END, 9) AS iou, round(CASE WHEN p + q = 0 THEN 0 ELSE 2.0 * c / (p + q) END, 9) AS dice FROM (SELECT *, len(list_filter(a, lambda x: x > 0.5)) AS p, len(list_filter(b, lambda x: x > 0.5)) AS q,
      len(list_filter(range(1, len(a) + 1), lambda i: a[i] > 0.5 AND b[i] > 0.5)) AS c, len(list_filter(range(1, len(a) + 1), lambda i: a[i] > 0.5 OR b[i] > 0.5)) AS u FROM
      (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x) * 4) AS a, list_transform(list_reverse(embedding)::DOUBLE[], lambda x: abs(x) * 4) AS b FROM embeddings)) WHERE p + q > 0""")
def mask_agreement(spark, d):
    """A33 of vectors as masks, each against its reverse."""
    m = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")) * 4)
    t = table(spark, d, "embeddings").select("vec_id", m(F.col("embedding")).alias("a"), m(F.reverse("embedding")).alias("b"))
    t = t.where(F.exists("a", lambda x: x > 0.5)).select("vec_id", U.mask_agreement(F.col("a"), F.col("b")).alias("m"))
    return t.select("vec_id", F.round("m.mse", 6).alias("mse"), F.round("m.sad", 4).alias("sad"), F.round("m.iou", 9).alias("iou"), F.round("m.dice", 9).alias("dice"))


@query(f"SELECT kind, folder, count(*) AS n FROM (SELECT f AS folder, CASE f {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in S.FOLDERS.items())} ELSE 'Khác' END AS kind FROM (SELECT ['CV', 'HD', 'K', 'QD', 'TT', 'XX'][{_BUCKET('doc_id', 6)} + 1] AS f FROM documents)) GROUP BY ALL")
def folder_kinds(spark, d):
    """Documents per folder and kind."""
    code = F.element_at(F.array(*[F.lit(x) for x in ("CV", "HD", "K", "QD", "TT", "XX")]), S.hash_bucket(F.col("doc_id"), 6) + 1)
    return table(spark, d, "documents").select(code.alias("folder")).groupBy(S.folder_kind(F.col("folder")).alias("kind"), "folder").agg(F.count("*").alias("n"))


# --- SQL of queries that stand in the catalogue ------------------------------------------------------------------------

ORACLE["region_texts"] = f"SELECT doc_id, region, string_agg(text, chr(10) ORDER BY line_no) AS text FROM ({_REGION_LINES}) GROUP BY doc_id, region"
ORACLE["log_sessions"] = """SELECT document_id, min(created_at) AS session_start, max(created_at) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM
    (SELECT *, sum(b) OVER (PARTITION BY document_id ORDER BY created_at, log_id) AS g FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY document_id ORDER BY created_at, log_id) >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b
      FROM (SELECT DISTINCT log_id, document_id, created_at FROM processing_logs WHERE created_at IS NOT NULL))) GROUP BY document_id, g"""


def _filled(field: str) -> str:
    return _strip(f"coalesce(extraction.{field}, '')")


_RULES = [f"CASE WHEN {_filled(f)} = '' THEN 'blank {f}' END" for f in M.FIELDS]
_RULES += [f"CASE WHEN regexp_matches(lower({_filled('co_quan_ban_hanh')}), 'độc lập|tự do|hạnh phúc') THEN 'motto as agency' END", f"CASE WHEN regexp_matches({_filled('nguoi_ky')}, '(?i)^(?:KT[.]|TM[.]|TL[.]|CHỦ TỊCH|GIÁM ĐỐC|BỘ TRƯỞNG)') THEN 'office as signer' END"]
_RULES += [f"CASE WHEN evidence IS NOT NULL AND {_filled(f)} <> '' AND NOT list_contains(map_keys(evidence), '{f}') THEN 'no evidence {f}' END" for f in M.FIELDS]
ORACLE["label_contract"] = f"SELECT rule, count(*) AS n FROM (SELECT unnest([{', '.join(_RULES)}]) AS rule FROM bench_labels) WHERE rule IS NOT NULL GROUP BY rule"
ORACLE["conversations"] = """SELECT label_id, CAST(to_json({'id': label_id::VARCHAR, 'conversations': [{'from': 'human', 'value': 'Số hiệu?'}, {'from': 'gpt', 'value': coalesce(extraction.so_hieu, '')}]}) AS VARCHAR) AS json FROM bench_labels"""
_NEAR = f"SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 5"
ORACLE["context_listagg"] = f"SELECT coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY distance), 'Không tìm thấy thông tin liên quan.') AS context FROM ({_NEAR}) n JOIN documents d ON d.doc_id = n.vec_id"
ORACLE["context_listagg_all"] = """SELECT query_id, coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY distance), 'Không tìm thấy thông tin liên quan.') AS context FROM
    (SELECT query_id, vec_id, distance FROM (SELECT q.vec_id AS query_id, v.vec_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 5) n
    LEFT JOIN documents d ON d.doc_id = n.vec_id GROUP BY query_id"""


def _without_watermarks(c: str) -> str:
    for p in T.WATERMARKS:
        flags, body = p[2 : p.index(")")].replace("u", ""), p[p.index(")") + 1 :].replace("\\z", "$")
        c = f"regexp_replace({c}, '(?{flags}){body}', '', 'g')"
    return _strip(c)


ORACLE["born_digital"] = f"""SELECT length({_without_watermarks("coalesce(full_text, '')")}) > 100 AS digital, count(*) AS n FROM bench_labels GROUP BY 1"""

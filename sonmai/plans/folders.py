"""Queries on files and folders: what is written is read back and held against the tables it came from."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import metrics as M
from ..operators import catalog as C
from ..operators import datasets as S
from ..operators import evaluation as E
from ..operators import governance as G
from ..operators import retrieval as R
from ..session import shared_folder, table
from ..sources import files as FILES
from .catalogue import _BUCKET, query

_STEM = lambda c: f"regexp_replace(regexp_extract({c}, '([^/\\\\]*)$', 1), '\\.[^.]*$', '')"


def _number(c: str):
    return F.regexp_extract(c, r"(\d+)[^/]*$", 1).cast("long")


def _item_files(spark: SparkSession, d: str, suffix: str, content, items: DataFrame | None = None) -> str:
    """A folder with a file for each held-out text, below its split."""
    at = shared_folder(spark, "items")
    t = table(spark, d, "eval_items") if items is None else items
    name = F.concat("eval_split", F.lit("/item_"), F.col("item_id").cast("string"), F.lit(suffix))
    FILES.write_named(t.select(name.alias("name"), content.alias("content")), at).agg(F.sum("length")).collect()
    return at


@query("SELECT item_id, md5(text) AS h FROM eval_items WHERE text IS NOT NULL")
def text_files(spark, d):
    """A text file for each item."""
    at = _item_files(spark, d, ".txt", F.col("text"), table(spark, d, "eval_items").where("text IS NOT NULL"))
    return FILES.texts(spark, f"{at}/*/*.txt").select(_number("path").alias("item_id"), F.md5("text").alias("h"))


@query("SELECT 'item_' || item_id AS stem, md5(text) AS h, task AS kind, eval_split AS number FROM eval_items")
def label_files(spark, d):
    """A JSON file for each item."""
    record = F.to_json(F.struct(F.col("item_id").alias("filename"), F.col("text").alias("full_text"), F.struct(F.col("task").alias("loai_van_ban"), F.col("eval_split").alias("so_hieu")).alias("extraction")))
    at = _item_files(spark, d, ".json", record)
    return FILES.label_files(spark, f"{at}/*/*.json").select("stem", F.md5("full_text").alias("h"), F.col("extraction.loai_van_ban").alias("kind"), F.col("extraction.so_hieu").alias("number"))


@query("SELECT name, short_name AS so_hieu FROM agency_ref WHERE name IS NOT NULL")
def keyed_truth(spark, d):
    """One JSON object of records by name."""
    at = shared_folder(spark, "truth")
    t = table(spark, d, "agency_ref").where("name IS NOT NULL")
    one = t.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.col("short_name").alias("so_hieu")))))).alias("content"))  # a reference list in one file
    FILES.write_named(one.select(F.lit("truth.json").alias("name"), "content"), at).collect()
    return FILES.keyed_records(spark, f"{at}/truth.json").select("name", "so_hieu")


@query("""SELECT 'item_' || item_id AS id, sha256(text) AS input_sha256, CASE WHEN item_id % 2 = 0 THEN sha256('label ' || item_id) END AS label_sha256, 'test' AS split, 'text' AS source_type FROM eval_items WHERE text IS NOT NULL""")
def manifest_files(spark, d):
    """A manifest of the files of a folder and their labels, written with its own hash and read again."""
    t = table(spark, d, "eval_items").where("text IS NOT NULL")
    inputs = FILES.scan(spark, _item_files(spark, d, ".txt", F.col("text"), t), ("txt",))
    labels = FILES.scan(spark, _item_files(spark, d, ".json", F.concat(F.lit("label "), F.col("item_id")), t.where("item_id % 2 = 0")), ("json",))
    made = G.build_manifest(inputs.select("path", "content"), labels.select("path", "content"), "test", "text").orderBy("id")
    rows = [r.asDict() for r in made.toLocalIterator()]  # a manifest is one file
    body = FILES.manifest_text({"schema_version": "1", "root": "/data"}, rows)
    at = shared_folder(spark, "manifest")
    FILES.write_named(spark.createDataFrame([("manifest.json", body)], "name string, content string"), at).collect()
    return FILES.manifest(spark, f"{at}/manifest.json").select("id", "input_sha256", "label_sha256", "split", "source_type")


@query("SELECT count(*) FILTER (event_id % 10 > 1) AS good, count(*) FILTER (event_id % 10 = 0) AS bad, CAST(sum(CASE WHEN event_id % 10 > 1 THEN event_id END) AS BIGINT) AS ids FROM events")
def json_lines(spark, d):
    """Lines of JSON, some broken, some blank."""
    at = shared_folder(spark, "lines")
    i = F.col("event_id") % 10
    line = F.when(i == 0, "{broken").when(i == 1, "").otherwise(F.to_json(F.struct(F.col("event_id").alias("k"))))
    FILES.write_text_rows(table(spark, d, "events").select(line.alias("line")), "line", at)
    t = FILES.json_lines(spark, at, "k long").select("k", F.col("_corrupt_record").isNotNull().alias("bad"))
    return t.agg(F.count_if(F.col("k").isNotNull()).alias("good"), F.count_if("bad").alias("bad"), F.sum("k").alias("ids"))


_HEADS = ("25504446", "89504E470D0A1A0A", "FFD8FF", "4D4D002A", "424D", "00112233")


@query(f"""SELECT doc_id, kind, CASE WHEN ext NOT IN ('pdf', 'png', 'jpg', 'tiff', 'bmp') THEN 'extension' WHEN kind IS NULL THEN 'content' WHEN kind <> ext THEN 'content is not as named' WHEN kind <> 'pdf' AND doc_id % 3 = 0 THEN 'mime type' END AS reason FROM
    (SELECT doc_id, ['pdf', 'png', 'jpg', 'tiff', 'bmp', NULL][{_BUCKET('doc_id', 6)} + 1] AS kind, replace(replace(lower(regexp_extract(filename, '\\.([^.]+)$', 1)), 'jpeg', 'jpg'), 'docx', 'doc') AS ext FROM upload_files WHERE filename IS NOT NULL)""")
def upload_checks(spark, d):
    """Kinds by content, and why uploads are refused."""
    t = table(spark, d, "upload_files").where("filename IS NOT NULL")
    head = F.unhex(F.element_at(F.array(*[F.lit(x) for x in _HEADS]), S.hash_bucket(F.col("doc_id"), 6) + 1))
    t = t.select("doc_id", "filename", F.concat(head, F.unhex(F.lit("0000000000"))).alias("content"), F.when(F.col("doc_id") % 3 == 0, "application/pdf").alias("mime"))
    return t.select("doc_id", FILES.file_kind(F.col("content")).alias("kind"), FILES.rejection(F.col("content"), F.col("filename"), F.col("mime")).alias("reason"))


_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"SELECT item_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^{_BLANK}*$')), chr(10)) || chr(10) || '[TABLE] ' || task) AS h FROM eval_items")
def docx_files(spark, d):
    """Paragraphs and cells of word-processor files."""

    @F.pandas_udf("binary")
    def docx(text: pd.Series, cell: pd.Series) -> pd.Series:
        def one(t, c):
            said = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{escape(x)}</w:t></w:r></w:p>" for x in t.split("\n"))
            body = f"{said}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f"<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>{body}</w:body></w:document>")
            return out.getvalue()

        return pd.Series([one(t, c) for t, c in zip(text, cell)])

    at = _item_files(spark, d, ".docx", docx("text", "task"))
    return FILES.docx(spark, at, True).select(_number("path").alias("item_id"), F.md5("text").alias("h"))


@query("SELECT eval_split AS folder, count(*) AS n_files, round(sum(octet_length(encode(text))) / 1048576.0::DOUBLE, 9) AS mb FROM eval_items GROUP BY 1")
def folder_usage(spark, d):
    """Files and megabytes of each folder, without reading them."""
    at = _item_files(spark, d, ".PNG", F.col("text"))
    t = FILES.usage(FILES.scan(spark, at, content=False))
    return t.select(F.regexp_extract("directory", "([^/]*)$", 1).alias("folder"), "n_files", F.round("mb", 9).alias("mb"))


@query(f"SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN {_BUCKET('doc_id', 100)} < 80 THEN 'train' WHEN {_BUCKET('doc_id', 100)} < 90 THEN 'val' ELSE 'test' END AS split FROM documents) GROUP BY split")
def split_files(spark, d):
    """K4, K6: JSON lines in a folder for each split."""
    at = shared_folder(spark, "splits")
    FILES.write_splits(table(spark, d, "documents").select("doc_id", "text", S.split(F.col("doc_id")).alias("split")), at)
    return spark.read.schema("doc_id long, text string, split string").json(at).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT agency_id, name, short_name FROM agency_ref")
def csv_export(spark, d):
    """K2 as text with a header."""
    at = shared_folder(spark, "csv")
    FILES.write_csv(table(spark, d, "agency_ref"), at)
    return spark.read.schema("agency_id long, name string, short_name string").csv(at, header=True)


@query("""SELECT line, count(*) AS n FROM (SELECT printf('%d %.6f %.6f %.6f %.6f', s.page, k((s.x1 + s.x2) / 2.0 / 1000), k((s.y1 + s.y2) / 2.0 / 1500), k((s.x2 - s.x1) / 1000.0), k((s.y2 - s.y1) / 1500.0)) AS line FROM
    (SELECT unnest(stamp_coordinates) AS s FROM extraction_results)) GROUP BY line""".replace("k(", "least(greatest(0.001::DOUBLE, 1.0::DOUBLE * ").replace(" / 1000)", " / 1000), 0.999)").replace(" / 1500)", " / 1500), 0.999)").replace(" / 1000.0)", " / 1000.0), 0.999)").replace(" / 1500.0)", " / 1500.0), 0.999)"))
def yolo_rows(spark, d):
    """Label rows of stamps in text files, the page as the class."""
    at = shared_folder(spark, "yolo")
    t = table(spark, d, "extraction_results").select(F.explode("stamp_coordinates").alias("s"))
    box = L.centre_size(*[F.col(f"s.{c}") for c in ("x1", "y1", "x2", "y2")], F.lit(1000), F.lit(1500))
    FILES.write_text_rows(t.select(L.yolo_row(F.col("s.page"), box).alias("row")), "row", at)
    return spark.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT document_id, count(*) AS n_stages, round(sum(duration), 4) AS seconds, count(*) FILTER (status = 'failed') AS n_failed FROM processing_logs GROUP BY document_id")
def batch_summaries(spark, d):
    """A summary record for each document as JSON lines."""
    at = shared_folder(spark, "summary")
    t = table(spark, d, "processing_logs").groupBy("document_id").agg(F.count("*").alias("n_stages"), F.round(F.sum("duration"), 4).alias("seconds"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.first("message").alias("image"))
    FILES.write_results(t, at, ("image",))
    return spark.read.schema("document_id long, n_stages long, seconds double, n_failed long").json(at)


@query("SELECT agency_id, name, short_name FROM agency_ref")
def database_table(spark, d):
    """A table of a relational data base, written and read in ranges of its key (an SQLite file in the shared folder, as executors have no memory in common)."""
    at = f"{shared_folder(spark, 'database')}/agencies.sqlite"
    t = table(spark, d, "agency_ref").select("agency_id", "name", "short_name")
    FILES.write_database(t, at, "agencies", "agency_id")
    return FILES.database(spark, at, "agencies", "agency_id", "agency_id long, name string, short_name string")


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings) WHERE label <> 2 GROUP BY label""")
def vector_collection(spark, d):
    """Vectors put in, a tenth of them replaced, those of one document taken out."""
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), "embedding")
    c = R.Collection(spark, shared_folder(spark, "vectors"))
    c.put(t)
    c.put(t.where("chunk_id % 10 = 0").withColumn("doc_id", F.lit(-1).cast(t.schema["doc_id"].dataType)))
    c.drop(2)
    return c.read().groupBy(F.col("doc_id").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 BETWEEN 1 AND num_pages THEN 'page_' || doc_id % 7 ELSE filename END AS path FROM upload_files")
def preview_paths(spark, d):
    """the path of a page from a JSON list, or the file itself."""
    pages = F.to_json(F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce("num_pages", F.lit(1)), F.lit(1))), lambda i: F.concat(F.lit("page_"), i.cast("string"))))
    t = table(spark, d, "upload_files").select("doc_id", "filename", "num_pages", F.from_json(pages, "array<string>").alias("pages"))
    pages = F.when(F.col("num_pages") >= 1, F.col("pages")).otherwise(F.array().cast("array<string>"))
    return t.select("doc_id", C.page_path(pages, (F.col("doc_id") % 7).cast("int"), F.col("filename")).alias("path"))


# --- pairing and audits of names ------------------------------------------------------------------------------------


@query(f"SELECT doc, count(*) AS n, bool_or(found) AS found FROM (SELECT {_STEM('m.input_path')} AS doc, b.label_id IS NOT NULL AS found FROM manifest_entries m LEFT JOIN bench_labels b ON {_STEM('m.input_path')} = {_STEM('b.filename')} WHERE m.input_path IS NOT NULL) GROUP BY doc")
def paired_by_stem(spark, d):
    """J3."""
    p = table(spark, d, "manifest_entries").where("input_path IS NOT NULL").select(F.col("input_path").alias("filename"), F.col("id").alias("extraction"))
    t = E.pair_by_stem(p, table(spark, d, "bench_labels"))
    return t.groupBy("doc").agg(F.count("*").alias("n"), F.bool_or(F.col("ground_truth").isNotNull()).alias("found"))


@query("SELECT u.doc_id AS doc_id, r.name AS name FROM upload_files u JOIN (SELECT DISTINCT regexp_replace(filename, '\\.pdf$', '_result.json') AS name FROM upload_files WHERE doc_id % 3 = 0) r ON replace(u.filename, '.pdf', '_result.json') = r.name")
def paired_results(spark, d):
    """Uploads with the results of every third."""
    u = table(spark, d, "upload_files").select("doc_id", "filename")
    r = u.where("doc_id % 3 = 0").select(F.concat(F.lit("/results/"), F.regexp_replace("filename", r"\.pdf$", "_result.json")).alias("path")).distinct()
    return E.with_results(u, r).select("doc_id", F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


@query("SELECT label_id FROM bench_labels WHERE filename IN (SELECT regexp_extract(input_path, '([^/]*)$', 1) FROM manifest_entries WHERE split = 'train')")
def existing_inputs(spark, d):
    """J6."""
    files = table(spark, d, "manifest_entries").where("split = 'train'").select(F.col("input_path").alias("path"))
    return E.existing(table(spark, d, "bench_labels").select("label_id", "filename"), files).select("label_id")


@query("SELECT filename FROM upload_files WHERE filename IS NOT NULL ORDER BY filename, doc_id LIMIT 100")
def first_files(spark, d):
    """The head of a run, files by name."""
    return table(spark, d, "upload_files").where("filename IS NOT NULL").orderBy("filename", "doc_id").limit(100).select("filename")


@query("SELECT label_id, row_number() OVER (ORDER BY label_id) AS r FROM bench_labels WHERE filename IS NOT NULL QUALIFY r <= 1000")
def natural_file_order(spark, d):
    """O2: the first thousand files by the number in their names."""
    t = C.natural_order(table(spark, d, "bench_labels").where("filename IS NOT NULL").select("label_id", F.regexp_replace("filename", "_0*", "_").alias("f")), "f").limit(1000)
    return t.select("label_id", F.col("label_id").alias("r"))


_LISTED = "['data/raw/', 'src/', 'docs/', 'logs/', 'data/test/labels/'][doc_id % 5 + 1] || filename"
_FINDINGS = f"""SELECT finding, path FROM (SELECT path, unnest([CASE WHEN b THEN 'blocked folder' END, CASE WHEN NOT a AND NOT b AND regexp_matches(path, '(?i)\\.(pt|pth|onnx|safetensors|bin|gguf|h5|pb|tflite|ckpt|pdf|docx|doc|db|sqlite|sqlite3|log)$') THEN 'blocked extension' END,
    CASE WHEN NOT a AND NOT b AND len > 52428800 THEN 'large file' END]) AS finding FROM (SELECT path, len, starts_with(path, 'docs/') OR starts_with(path, 'data/test/labels/') AS a, starts_with(path, 'data/raw/') OR starts_with(path, 'logs/') AS b FROM
      (SELECT {_LISTED} AS path, file_size * 40 AS len FROM upload_files WHERE filename IS NOT NULL))) WHERE finding IS NOT NULL"""


def _findings(spark, d):
    folder = F.element_at(F.array(*[F.lit(x) for x in ("data/raw/", "src/", "docs/", "logs/", "data/test/labels/")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return G.misplaced_files(table(spark, d, "upload_files").where("filename IS NOT NULL").select(F.concat(folder, "filename").alias("path"), (F.col("file_size") * 40).alias("length")))


@query(f"SELECT finding, count(*) AS n FROM ({_FINDINGS}) GROUP BY finding")
def misplaced_files(spark, d):
    """F17."""
    return _findings(spark, d).groupBy("finding").agg(F.count("*").alias("n"))


@query(f"SELECT finding, path, rank, n FROM (SELECT finding, path, row_number() OVER (PARTITION BY finding ORDER BY path) AS rank, count(*) OVER (PARTITION BY finding) AS n FROM ({_FINDINGS})) WHERE rank <= CASE WHEN finding = 'blocked folder' THEN 20 ELSE 30 END")
def findings_report(spark, d):
    """Lists of findings cut to 30 and 20, with the numbers of all."""
    return G.findings_report(_findings(spark, d)).select("finding", "path", "rank", "n")


_PAGED = "SELECT doc_id, num_pages, file_type, CASE WHEN doc_id % 4 = 0 THEN md5(doc_id::VARCHAR) || '_page_1.jpg' ELSE filename END AS filename, 'uploads/' || CASE WHEN doc_id % 4 = 0 THEN md5(doc_id::VARCHAR) || '_page_1.jpg' ELSE filename END AS file_path FROM upload_files"


@query(f"""SELECT doc_id, CASE WHEN there THEN md5(doc_id::VARCHAR) || '.pdf' ELSE filename END AS filename, CASE WHEN there THEN 'uploads/' || md5(doc_id::VARCHAR) || '.pdf' ELSE file_path END AS file_path, CASE WHEN there OR (doc_id % 4 = 0 AND num_pages > 1) THEN 'pdf' ELSE file_type END AS file_type
    FROM (SELECT *, doc_id % 8 = 0 AS there FROM ({_PAGED}))""")
def repaired_names(spark, d):
    """F16: every fourth document named as a page; the originals of every eighth are there."""
    page = F.concat(F.md5(F.col("doc_id").cast("string")), F.lit("_page_1.jpg"))
    t = table(spark, d, "upload_files").select("doc_id", "num_pages", "file_type", F.when(F.col("doc_id") % 4 == 0, page).otherwise(F.col("filename")).alias("filename"))
    t = t.withColumn("file_path", F.concat(F.lit("uploads/"), "filename"))
    files = t.where("doc_id % 8 = 0").select(F.concat(F.lit("uploads/"), F.md5(F.col("doc_id").cast("string")), F.lit(".pdf")).alias("path"))
    return C.repaired_names(t, files).select("doc_id", "filename", "file_path", "file_type")


@query("""WITH i AS (SELECT regexp_extract(filename, '^(.*)\\.', 1) AS stem FROM bench_labels WHERE label_id % 5 <> 0), l AS (SELECT id AS stem FROM manifest_entries WHERE id IS NOT NULL)
    SELECT issue, count(*) AS n FROM (SELECT 'duplicate input stem' AS issue FROM i GROUP BY stem HAVING count(*) > 1 UNION ALL SELECT 'duplicate label stem' FROM l GROUP BY stem HAVING count(*) > 1
      UNION ALL SELECT 'input without label' FROM (SELECT DISTINCT stem FROM i) WHERE stem NOT IN (SELECT stem FROM l) UNION ALL SELECT 'label without input' FROM (SELECT DISTINCT stem FROM l) WHERE stem NOT IN (SELECT stem FROM i)) GROUP BY issue""")
def pairing_messages(spark, d):
    """Q8."""
    i = table(spark, d, "bench_labels").where("label_id % 5 <> 0").select(F.regexp_extract("filename", r"^(.*)\.", 1).alias("stem"))
    l = table(spark, d, "manifest_entries").where("id IS NOT NULL").select(F.col("id").alias("stem"))
    return G.pairing_messages(i, l).groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT 'results/Benchmark_' || event_id || '.json' AS path FROM events WHERE event_id % 3 = 0 AND json_valid(props)")
def unproven_results(spark, d):
    """Q9: every third result is named as a benchmark; none says its manifest."""
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("results/Benchmark_"), F.col("event_id"), F.lit(".json"))).otherwise(F.concat(F.lit("results/run_"), F.col("event_id"), F.lit(".json")))
    return G.unproven_results(table(spark, d, "events").select(name.alias("path"), F.col("props").alias("body")))


@query("SELECT field, count(*) AS n, 'test' AS split, 'a1' AS commit FROM (SELECT unnest(['loai_van_ban', 'so_hieu', 'ngay_ban_hanh', 'co_quan_ban_hanh', 'trich_yeu', 'nguoi_ky']) AS field FROM extraction_results) GROUP BY field")
def proven_run(spark, d):
    """Q10, Q11, K7, K9: an official run over the whole manifest, its result with the facts of the run, as a file."""
    G.official_gate(True, "manifest", None)
    t = table(spark, d, "extraction_results").select(F.explode(F.array(*[F.lit(f) for f in M.FIELDS])).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    at = shared_folder(spark, "run")
    FILES.write_results(G.provenance(t, commit="a1", split="test"), at)
    return spark.read.schema("field string, n long, provenance struct<commit:string,split:string>").json(at).select("field", "n", "provenance.split", "provenance.commit")


@query("""SELECT '| ' || stage || ' | ' || count(*) || ' | ' || CASE WHEN avg(duration) IS NULL THEN 'N/A' ELSE printf('%.4f', avg(duration)) END || ' |' AS line FROM processing_logs WHERE stage IS NOT NULL GROUP BY stage UNION ALL SELECT '| stage | n | mean |' UNION ALL SELECT '| --- | --- | --- |'""")
def report_table(spark, d):
    """A small result as a page and as a table of text, one row per line of the table."""
    t = table(spark, d, "processing_logs").where("stage IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n"), F.avg("duration").alias("mean")).orderBy("stage")
    rows = [r.asDict() for r in t.collect()]  # one row per stage
    assert "<table>" in E.html_report("Stages", {"stages": rows})
    return spark.createDataFrame([(x,) for x in E.markdown_table(rows, ["stage", "n", "mean"]).split("\n")], "line string")


@query("SELECT document_id, stage, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, log_id DESC) AS r FROM processing_logs WHERE created_at IS NOT NULL) WHERE r = 1")
def newest_state_stream(spark, d):
    """T-1, T-2: the newest row of each document by batches of a stream, merged into a table."""
    from ..streaming import logs as LOGS

    at = shared_folder(spark, "state")
    done = []

    def merge(batch: DataFrame, number: int) -> None:
        new = batch
        if done:
            both = batch.sparkSession.read.parquet(done[-1]).unionByName(batch)
            new = both.groupBy("document_id").agg(F.max_by(F.struct("stage", "status", "created_at"), "created_at").alias("s")).select("document_id", "s.*")
        new.write.mode("overwrite").parquet(f"{at}/v{number}")
        done.append(f"{at}/v{number}")

    LOGS.latest_in_batches(LOGS.read_logs(spark, f"{d.rstrip('/')}/processing_logs.parquet").where("created_at IS NOT NULL"), merge, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(done[-1]).select("document_id", "stage", "status")


@query("SELECT a.filename AS filename, count(*) AS n FROM upload_files a JOIN upload_files b ON a.filename = b.filename WHERE lower(a.file_type) IN ('jpg', 'png', 'jpeg') AND b.doc_id % 2 = 0 GROUP BY a.filename")
def paired_images(spark, d):
    """Clean images with the outputs of the same name, those of every second upload."""
    u = table(spark, d, "upload_files")
    clean, made = u.where("lower(file_type) IN ('jpg', 'png', 'jpeg')").select("filename"), u.where("doc_id % 2 = 0").select("filename")
    return clean.join(made, "filename").groupBy("filename").agg(F.count("*").alias("n"))


@query("""SELECT kind, count(*) AS n, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM (SELECT unnest(['txt', 'json', 'meta']) AS kind, unnest([text, '{"task":"' || task || '"}', '{"id":' || item_id || '}']) AS content FROM eval_items) GROUP BY kind""")
def stage_export(spark, d):
    """The text, the record and the facts of each item as files of its own folder."""
    at = shared_folder(spark, "stages")
    i = F.col("item_id").cast("string")
    part = lambda name, c: F.struct(F.concat(i, F.lit("/" + name)).alias("name"), c.alias("content"))
    parts = F.array(part("text.txt", F.col("text")), part("record.json", F.to_json(F.struct("task"))), part("facts.meta", F.to_json(F.struct(F.col("item_id").alias("id")))))
    FILES.write_named(table(spark, d, "eval_items").select(F.inline(parts)), at).agg(F.sum("length")).collect()
    t = FILES.scan(spark, at, ("txt", "json", "meta"), content=False)
    return t.groupBy(F.regexp_extract("path", r"\.([^.]+)$", 1).alias("kind")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))

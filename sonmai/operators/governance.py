"""Audits of data sets: manifests, hashes, splits, pairing (inventory Q1-Q12, J6-J8, U4, U6, F17, O6, K3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import FIELDS
from ..functions.text import strip, text


def sha256(c: Column) -> Column:
    """Q1: of a text or a file's content, in hex."""
    return F.sha2(c.cast("binary"), 256)


def required_missing(entries: DataFrame, columns: tuple[str, ...] = ("id", "input_path", "input_sha256")) -> DataFrame:
    """Q3: (rule, n) for each required field that is missing or blank."""
    rows = [F.struct(F.lit("missing " + c).alias("rule"), (strip(text(F.col(c))) == "").cast("int").alias("hit")) for c in columns]
    return entries.select(F.inline(F.array(*rows))).groupBy("rule").agg(F.sum("hit").alias("n"))


def hash_problems(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Q4: (id, problem) of entries whose input or label is missing or differs. files: (path, sha256)."""
    f = files.select("path", F.lower("sha256").alias("h"))
    i, l = f.select(F.col("path").alias("input_path"), F.col("h").alias("ih")), f.select(F.col("path").alias("label_path"), F.col("h").alias("lh"))
    t = entries.join(i, "input_path", "left").join(l, "label_path", "left")
    problems = F.array(
        F.when(F.col("ih").isNull(), "missing input").when(F.col("ih") != F.lower("input_sha256"), "input hash mismatch"),
        F.when(F.col("label_path").isNull(), "missing label_path").when(F.col("lh").isNull(), "missing label").when(F.col("lh") != F.lower("label_sha256"), "label hash mismatch"),
    )
    return t.select("id", F.explode(F.array_compact(problems)).alias("problem"))


def split_of(c: Column) -> Column:
    return F.lower(strip(c))


def split_leakage(entries: DataFrame) -> DataFrame:
    """Q6: (sha, splits, n) of inputs that stand in more than one split; the splits of a hash are at most the few there are."""
    t = entries.where("input_sha256 IS NOT NULL AND split IS NOT NULL").groupBy(F.lower("input_sha256").alias("sha"), split_of(F.col("split")).alias("split")).agg(F.count("*").alias("n"))
    return t.groupBy("sha").agg(F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1").drop("k")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of values that stand more than once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def pairing_messages(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """Q8: (issue, stem): stems that several inputs or labels have, labels without input, inputs without label, and either side wholly missing. inputs, labels: (stem)."""
    twice = lambda t, side: duplicates(t, "stem").select(F.lit(f"duplicate {side} stem").alias("issue"), "stem")
    alone = unpaired(inputs, labels, "stem").select(F.when(F.col("side") == "left", "input without label").otherwise("label without input").alias("issue"), "stem")
    n = inputs.agg(F.count("stem").alias("i")).crossJoin(labels.agg(F.count("stem").alias("l")))  # two rows of one number
    none = n.select(F.when((F.col("l") > 0) & (F.col("i") == 0), "labels but no inputs").when((F.col("i") > 0) & (F.col("l") == 0), "inputs but no labels").alias("issue"), F.lit(None).cast("string").alias("stem")).where("issue IS NOT NULL")
    return twice(inputs, "input").unionByName(twice(labels, "label")).unionByName(alone).unionByName(none)


def unproven_results(results: DataFrame) -> DataFrame:
    """Q9: (path): JSON results named as a benchmark that don't say which manifest they are of. results: (path, body); what isn't JSON passes."""
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    v = F.try_parse_json("body")
    proof = F.try_variant_get(v, "$.manifest_sha256", "string")
    return results.where(name.endswith(".json") & name.contains("benchmark") & v.isNotNull() & (F.coalesce(proof, F.lit("")) == "")).select("path")


# What doesn't belong into a repository of code.
BLOCKED = (".pt", ".pth", ".onnx", ".safetensors", ".bin", ".gguf", ".h5", ".pb", ".tflite", ".ckpt", ".pdf", ".docx", ".doc", ".db", ".sqlite", ".sqlite3", ".log")
BLOCKED_DIRS = ("data/uploads", "data/raw", "data/interim", "data/processed", "data/llm_training", "data/raw_word_files", "apps/backend/uploads", "apps/frontend/public/temp_uploads", "backend/uploads", "results", "debug_outputs", "artifacts", "outputs", "runs", "wandb", "mlruns", "logs", "pgdata", "postgres_data", "redis-data", "redis_data", "chromadb", "cache", ".tmp", "tmp", "unsloth_compiled_cache")
ALLOWED = ("README.md", "docs/", ".gitkeep", "data/test/labels/")
LARGE = 50 * 1024 * 1024


def misplaced_files(files: DataFrame) -> DataFrame:
    """(finding, path) of files that are of a blocked kind, in a blocked folder or too large, allowed ones left out. files: (path, length), relative."""
    p = F.col("path")
    allowed = reduce(Column.__or__, [p.startswith(a) for a in ALLOWED])
    ext = F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))
    folder = reduce(Column.__or__, [p.startswith(d + "/") for d in BLOCKED_DIRS])
    findings = F.array(
        F.when(folder & ~p.endswith("/.gitkeep"), "blocked folder"),
        F.when(~allowed & ext.isin(*BLOCKED) & ~folder, "blocked extension"),
        F.when(~allowed & (F.col("length") > LARGE) & ~folder, "large file"),
    )
    return files.select(F.explode(F.array_compact(findings)).alias("finding"), "path")


def findings_report(findings: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """The first paths of each finding, by name, and the number of all (a report cut to 30, 20 for folders)."""
    w = Window.partitionBy("finding").orderBy("path")
    most = most or {"blocked folder": 20}
    limit = reduce(lambda c, kv: c.when(F.col("finding") == kv[0], kv[1]), most.items(), F).otherwise(30)
    n = findings.groupBy("finding").agg(F.count("*").alias("n"))
    return findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).join(F.broadcast(n), "finding")


def manifest_rules(entries: DataFrame) -> DataFrame:
    """Q5: (rule, id) of entries that break a rule of the manifest."""
    bad = lambda rule, cond: entries.where(cond).select(F.lit(rule).alias("rule"), "id")
    blank = lambda c: strip(text(F.col(c))) == ""
    twice = duplicates(entries.dropDuplicates(), "id").select(F.lit("duplicate id").alias("rule"), "id")
    parts = [bad("no split", blank("split")), bad("no source type", blank("source_type")), bad("label without hash", ~blank("label_path") & blank("label_sha256")), bad("hash of odd length", ~blank("input_sha256") & (F.length("input_sha256") != 64)), twice]
    return reduce(DataFrame.unionByName, parts)


def label_contract(labels: DataFrame, key: str = "label_id") -> DataFrame:
    """Q12: (key, rule): required fields that are blank, an agency that is the motto, a signer that is an office, fields without evidence where there is some."""
    e = lambda f: strip(text(F.col(f"extraction.{f}")))
    rules = [F.when(e(f) == "", F.lit("blank " + f)) for f in FIELDS]
    rules += [F.when(F.lower(e("co_quan_ban_hanh")).rlike("độc lập|tự do|hạnh phúc"), F.lit("motto as agency")), F.when(e("nguoi_ky").rlike(r"(?iu)^(?:KT\.|TM\.|TL\.|CHỦ TỊCH|GIÁM ĐỐC|BỘ TRƯỞNG)"), F.lit("office as signer"))]
    rules += [F.when(F.col("evidence").isNotNull() & (e(f) != "") & ~F.map_contains_key(F.col("evidence"), F.lit(f)), F.lit("no evidence " + f)) for f in FIELDS]
    return labels.select(key, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def build_manifest(files: DataFrame, labels: DataFrame, split: str, source_type: str) -> DataFrame:
    """Q7: entries of input files with the labels of their stems. files, labels: (path, content)."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    l = labels.select(stem(F.col("path")).alias("id"), F.col("path").alias("label_path"), sha256(F.col("content")).alias("label_sha256"))
    i = files.select(stem(F.col("path")).alias("id"), F.col("path").alias("input_path"), sha256(F.col("content")).alias("input_sha256"))
    return i.join(l, "id", "left").select("id", "input_path", "input_sha256", "label_path", "label_sha256", F.lit(split).alias("split"), F.lit(source_type).alias("source_type"))


def official_gate(official: bool, manifest: object | None, limit: int | None) -> None:
    """Q10: an official run needs a manifest and takes all of it."""
    if official and manifest is None:
        raise ValueError("an official run requires a manifest")
    if official and limit is not None:
        raise ValueError("an official run cannot use a limit")


def provenance(df: DataFrame, **facts: str) -> DataFrame:
    """Q11: adds a struct of facts about the run."""
    return df.withColumn("provenance", F.struct(*[F.lit(v).alias(k) for k, v in sorted(facts.items())]))

"""Evaluation of extracted fields against labels (inventory J3-J6, A9-A25, M10, M12, K7, K10, K11)."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.dates import comparable_value
from ..functions.text import strip, text
from .datasets import numbered

TABLE_ROWS = 1_000_000  # 8 MB
STATUSES = ("both_empty", "missed", "extra", "correct", "wrong")


def stem(c: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def pair_by_stem(pred: DataFrame, truth: DataFrame, name: str = "filename") -> DataFrame:
    """Every prediction with the label of the same stem; columns predicted and ground_truth."""
    t = truth.select(stem(F.col(name)).alias("doc"), F.col("extraction").alias("ground_truth"))
    return pred.select(stem(F.col(name)).alias("doc"), F.col("extraction").alias("predicted")).join(t, "doc", "left")


def first_match(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """The first label whose source or filename is the prediction's source: two equi-joins and a rank instead of an OR."""
    t = truth.select("seq", "source", "filename", "truth")
    by_source = pred.join(t.select("seq", "source", "truth"), "source")
    by_name = pred.join(t.select("seq", F.col("filename").alias("source"), "truth"), "source")
    w = Window.partitionBy("pred_id").orderBy("seq")
    return by_source.unionByName(by_name).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_results(truth: DataFrame, results: DataFrame, name: str = "filename") -> DataFrame:
    """Labels with the result of their file, x.pdf with x_result.json; labels without one are left out. results: (path, …)."""
    r = results.withColumn("_name", F.regexp_extract("path", r"([^/\\]*)$", 1))
    return truth.withColumn("_name", F.replace(name, F.lit(".pdf"), F.lit("_result.json"))).join(r, "_name").drop("_name")


def existing(truth: DataFrame, files: DataFrame, name: str = "filename") -> DataFrame:
    """Labels whose file is there. files: (path)."""
    return truth.join(files.select(F.regexp_extract("path", r"([^/\\]*)$", 1).alias(name)), name, "left_semi")


def error_rates(rates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of character and word error rates. rates: (cer, wer)."""
    return rates.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in ("cer", "wer") for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.count("*").alias("n"))


def merged_truth(parts: DataFrame, key: str, order: str) -> DataFrame:
    """Of several parts' rows of a key, the last part's."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return parts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def long_form(pairs: DataFrame, key: str = "doc", predicted: str = "predicted", truth: str = "ground_truth") -> DataFrame:
    """(doc, field, predicted, ground_truth): one row per document and field."""
    rows = [F.struct(F.lit(f).alias("field"), text(F.col(f"{predicted}.{f}")).alias("predicted"), text(F.col(f"{truth}.{f}")).alias("ground_truth")) for f in M.FIELDS]
    return pairs.select(key, F.inline(F.array(*rows)))


def field_metrics(long: DataFrame) -> DataFrame:
    """Status and agreement of each field."""
    p, t = F.col("predicted"), F.col("ground_truth")
    date = F.col("field").isin(*M.DATE_FIELDS)
    value = lambda c, ai=False: F.when(date, comparable_value(c, True, ai)).otherwise(comparable_value(c, False, ai))
    base = long.withColumns({"_p": value(p), "_t": value(t), "_pa": value(p, True), "_ta": value(t, True)})
    status = (
        F.when((strip(p) == "") & (strip(t) == ""), "both_empty").when(strip(p) == "", "missed").when(strip(t) == "", "extra").when(F.col("_p") == F.col("_t"), "correct").otherwise("wrong")
    )
    return base.withColumns(
        {
            "status": status,
            "strict": (p == t).cast("double"),
            "normalized": (F.col("_p") == F.col("_t")).cast("double"),
            "accent_free": (F.col("_pa") == F.col("_ta")).cast("double"),
            "token_f1": M.token_f1(F.col("_p"), F.col("_t")),
            "similarity": M.char_similarity(F.col("_p"), F.col("_t")),
        }
    ).drop("_p", "_t", "_pa", "_ta")


SCORES = ("strict", "normalized", "accent_free", "token_f1", "similarity")


def document_macro(metrics: DataFrame, key: str = "doc") -> DataFrame:
    """Means over the fixed six fields of each document."""
    return metrics.groupBy(key).agg(*[F.avg(s).alias(s) for s in SCORES])


def field_means(metrics: DataFrame) -> DataFrame:
    """A13."""
    return metrics.groupBy("field").agg(*[F.avg(s).alias(s) for s in SCORES])


def status_matrix(metrics: DataFrame) -> DataFrame:
    """Fields by status, one pass."""
    return metrics.groupBy("field").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def field_accuracy(metrics: DataFrame) -> DataFrame:
    """A10, A19."""
    ok = F.col("status").isin("correct", "both_empty")
    return metrics.groupBy("field").agg(F.count_if(ok).alias("correct"), F.count_if(~ok).alias("wrong"), F.count("*").alias("total"), F.avg(ok.cast("int")).alias("accuracy"))


def all_fields_correct(metrics: DataFrame, key: str = "doc") -> DataFrame:
    """Documents with all six fields right."""
    return metrics.groupBy(key).agg(F.bool_and(F.col("status").isin("correct", "both_empty")).alias("ok")).agg(F.count_if("ok").alias("n_correct"), F.count("*").alias("n_docs"))


def prf(metrics: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each field, and of all together ('micro')."""
    s = F.col("status")
    counts = lambda t, k: t.groupBy(*k).agg(F.count_if(s == "correct").alias("tp"), F.count_if(s.isin("wrong", "extra")).alias("fp"), F.count_if(s.isin("wrong", "missed")).alias("fn"))
    both = counts(metrics, ["field"]).unionByName(counts(metrics.withColumn("field", F.lit("micro")), ["field"]))
    p, r = M.precision(F.col("tp"), F.col("fp")), M.recall(F.col("tp"), F.col("fn"))
    return both.withColumns({"precision": p, "recall": r, "f1": M.f1(p, r)})


def legacy_f1(long: DataFrame, key: str = "doc") -> DataFrame:
    """Per document, with credit for containment; wrong values count as false positives only, extra ones not at all."""
    p, t = F.lower(strip(F.col("predicted"))), F.lower(strip(F.col("ground_truth")))
    hit = (p != "") & (t != "") & (p.contains(t) | t.contains(p))
    c = long.groupBy(key).agg(F.count_if(hit).alias("tp"), F.count_if((p != "") & (t != "") & ~hit).alias("fp"), F.count_if((p == "") & (t != "")).alias("fn"))
    pr, re = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * pr * re, pr + re), F.lit(0.0)))


def pooled_nonempty(metrics: DataFrame) -> DataFrame:
    """Means over fields that the truth fills, per field and pooled."""
    t = metrics.where(F.trim("ground_truth") != "")
    agg = [F.avg(s).alias(s) for s in ("normalized", "similarity", "token_f1")]
    return t.groupBy("field").agg(*agg).unionByName(t.withColumn("field", F.lit("pooled")).groupBy("field").agg(*agg))


def completeness(df: DataFrame, prefix: str = "extraction") -> DataFrame:
    """Filled and total numbers of each field."""
    rows = [F.struct(F.lit(f).alias("field"), (F.trim(text(F.col(f"{prefix}.{f}"))) != "").alias("filled")) for f in M.FIELDS]
    t = df.select(F.inline(F.array(*rows)))
    return t.groupBy("field").agg(F.count_if("filled").alias("filled"), F.count("*").alias("total"), F.avg(F.col("filled").cast("int")).alias("rate"))


def run_summary(runs: DataFrame, seconds: str = "duration", status: str = "status", ok: str = "completed") -> DataFrame:
    """One row about a run; times and means of successful results only; 0 and NULL for none."""
    good = F.col(status) == ok
    s = F.when(good, F.col(seconds))
    return runs.agg(
        F.count("*").alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"), F.coalesce(F.avg(good.cast("int")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum(s), F.lit(0.0)).alias("sum_seconds"), F.avg(s).alias("avg_seconds"), F.median(s).alias("median_seconds"), F.min(s).alias("min_seconds"), F.max(s).alias("max_seconds"),
    )


def bootstrap_hashed(df: DataFrame, key: str, value: str, iterations: int = 200, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by resampling with hashes, the same on any engine.

    A place of a resample draws a row by the hash of iteration and place, so the draws are a narrow pass; rows are numbered
    in the order of their keys' hashes. Up to TABLE_ROWS values are broadcast and looked up in that pass; more are joined.
    """
    t = numbered(df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")), "key", seed)
    t = t.select(F.col("_r").alias("i"), F.col("_all").alias("n"), "v")
    draws = t.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("b"), F.col("i"))), 1, 12), 16, 10).cast("long"), F.col("n")) + 1
    rows = t.limit(TABLE_ROWS + 1).collect()
    if len(rows) <= TABLE_ROWS:  # few values go to all tasks, which add up their draws of each iteration
        table = np.zeros(len(rows) + 1)
        for r in rows:
            table[r.i] = r.v
        shared = df.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf("double")
        def drawn(i: pd.Series) -> pd.Series:
            return pd.Series(shared.value[i.to_numpy()])

        picked = draws.select("b", drawn(at).alias("v"))
    else:
        picked = draws.select("b", at.alias("i")).join(t.select("i", "v"), "i")
    means = picked.groupBy("b").agg(F.avg("v").alias("m"))
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    return means.agg(F.percentile("m", F.lit(lo)).alias("lower"), F.percentile("m", F.lit(hi)).alias("upper"), F.count("*").alias("iterations"))


def json_valid_rate(df: DataFrame, c: str) -> DataFrame:
    """A23."""
    ok = F.try_parse_json(F.nullif(F.trim(c), F.lit(""))).isNotNull()
    return df.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), F.avg(ok.cast("int")).alias("rate"))


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A small result as a table of text."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    cell = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([cell(r.get(c)) for c in columns]) for r in rows]])


def html_report(title: str, sections: dict[str, list[dict]]) -> str:
    """Small results as a page; every value is escaped, what is no number where one belongs is N/A."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2><table>")
        cols = list(rows[0]) if rows else []
        out.append("<tr>" + "".join(f"<th>{html.escape(str(c))}</th>" for c in cols) + "</tr>")
        for r in rows:
            out.append("<tr>" + "".join(f"<td>{'N/A' if r[c] is None else html.escape(f'{r[c]:.4f}' if isinstance(r[c], float) else str(r[c]))}</td>" for c in cols) + "</tr>")
        out.append("</table>")
    return "".join(out)

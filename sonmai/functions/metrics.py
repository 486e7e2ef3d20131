"""Measures of agreement between texts and values (inventory M1-M16)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import comparable_value
from .text import strip, text, words

FIELDS = ("loai_van_ban", "so_hieu", "ngay_ban_hanh", "co_quan_ban_hanh", "trich_yeu", "nguoi_ky")
DATE_FIELDS = ("ngay_ban_hanh",)


def _guarded(a: Column, b: Column, score: Column) -> Column:
    """1 where both sides are empty, 0 where one is, else the score. a, b: numbers of members."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(score)


def token_f1(pred: Column, truth: Column) -> Column:
    """M1: F1 of the words as multisets."""
    a, b = words(pred), words(truth)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return _guarded(F.size(a), F.size(b), 2.0 * common / (F.size(a) + F.size(b)))


def token_f1_set(pred: Column, truth: Column) -> Column:
    """M2: F1 of the words as sets."""
    a, b = F.array_distinct(words(pred)), F.array_distinct(words(truth))
    return _guarded(F.size(a), F.size(b), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def char_similarity(pred: Column, truth: Column) -> Column:
    """M4: 1 less the edit distance over the longer length."""
    a, b = text(pred), text(truth)
    return _guarded(F.length(a), F.length(b), F.greatest(F.lit(0.0), 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))))


def char_set_similarity(pred: Column, truth: Column) -> Column:
    """M6: common characters over all characters."""
    a, b = (F.array_distinct(F.filter(F.split(text(c), ""), lambda x: x != "")) for c in (pred, truth))
    return _guarded(F.size(a), F.size(b), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def cer(truth: Column, pred: Column) -> Column:
    """M7: edit distance over the length of the truth; an empty truth gives 0 against nothing, else 1."""
    r, h = text(truth), text(pred)
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


def cer_stripped(pred: Column, truth: Column) -> Column:
    """M7, the other order of arguments, outer white space left out."""
    return cer(strip(text(truth)), strip(text(pred)))


def word_edits(a: list[str], b: list[str]) -> int:
    """The edit distance of two sequences of words, by Myers' bit vectors over integers of any length."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m = len(a)
    if not m or not b:
        return m + len(b)
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    for w in b:
        eq = at.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(d | up) & mask, d & up
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | 1) & mask
        up, down = (minus << 1) & mask | ~(x | plus) & mask, plus & x
    return score


def wer(truth: Column, pred: Column) -> Column:
    """M8: word-level edit distance over the words of the truth, of texts of any length."""

    @F.pandas_udf("int")
    def edits(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([word_edits(list(a), list(b)) for a, b in zip(r, h)], dtype="int32")

    r, h = words(truth), words(pred)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(edits(r, h) / F.size(r))


def field_status(pred: Column, truth: Column, is_date: bool = False) -> Column:
    """M9: emptiness on the raw values, correctness on the comparable ones."""
    p, t = strip(text(pred)), strip(text(truth))
    return (
        F.when((p == "") & (t == ""), "both_empty")
        .when(p == "", "missed")
        .when(t == "", "extra")
        .when(comparable_value(pred, is_date) == comparable_value(truth, is_date), "correct")
        .otherwise("wrong")
    )


def contained(pred: Column, truth: Column) -> Column:
    """One contains the other; blank only equals blank."""
    p, t = strip(text(pred)), strip(text(truth))
    return F.when((p == "") | (t == ""), (p == "") & (t == "")).otherwise(p.contains(t) | t.contains(p))


def precision(tp: Column, fp: Column) -> Column:
    """0 for nothing predicted."""
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return precision(tp, fn)


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))


def f1_epsilon(tp: Column, fp: Column, fn: Column, eps: float = 1e-9) -> Column:
    """With an epsilon in every denominator."""
    p, r = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return 2 * p * r / (p + r + eps)


def json_number(c: Column, path: str) -> Column:
    """A number at a dotted path of a JSON text; NULL where it is missing or no number."""
    v = F.try_parse_json(c)
    return F.coalesce(F.try_variant_get(v, "$." + path, "double"), F.try_variant_get(v, "$." + path, "boolean").cast("double"))


def throughput(seconds: Column) -> Column:
    """Items per second from the mean seconds an item takes."""
    return F.try_divide(F.lit(1.0), F.avg(seconds))


def upper_median(c: Column) -> Column:
    """The middle value, the upper of two (an aggregate)."""
    a = F.array_sort(F.collect_list(c))
    return F.try_element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)

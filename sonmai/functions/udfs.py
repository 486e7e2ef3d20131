"""Functions that built-in expressions can't express (inventory M5, Q2, R2, S7, S8, M12, A33); Arrow batches throughout."""

from __future__ import annotations

import difflib
import hashlib
import io
import json
import random
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import FIELDS

# Other names of the six fields in replies of language models.
ALIASES = {
    "loai_van_ban": ("loai_van_ban", "loai", "loại", "loại_văn_bản", "bản.loại", "type", "document_type"),
    "so_hieu": ("so_hieu", "so", "số", "số_hiệu", "bản.số", "number", "ma_so"),
    "ngay_ban_hanh": ("ngay_ban_hanh", "ngay_cap", "ngay_ky", "ngay", "ngày", "ngày_ban_hành", "bản.ngày", "date", "ngay_thang"),
    "co_quan_ban_hanh": ("co_quan_ban_hanh", "noi_cap", "co_quan", "cơ_quan", "cơ_quan_ban_hành", "don_vi", "to_chuc", "issuing_authority", "organization"),
    "trich_yeu": ("trich_yeu", "noi_dung", "nội_dung", "trích_yếu", "tieu_de", "tiêu_đề", "mo_ta", "subject", "summary", "content", "bản.nội_dung"),
    "nguoi_ky": ("nguoi_ky", "nguoi_ky_ten", "người_ký", "người_ký.tên", "người_ký.họ_tên", "signer", "ten_nguoi_ky", "signed_by"),
}


_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})")


def difflib_ratio(a: Column, b: Column) -> Column:
    """M5: Ratcliff and Obershelp's similarity; empties as in the other measures."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not p and not q else 0.0 if not p or not q else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x.fillna(""), y.fillna(""))])

    return ratio(a, b)


def canonical_hash(c: Column, without: tuple[str, ...] = ()) -> Column:
    """Q2: SHA-256 of a JSON text with sorted keys and no blanks, some top-level keys left out; NULL for no JSON."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                v = json.loads(x)
            except (TypeError, ValueError):
                return None
            if isinstance(v, dict):
                v = {k: w for k, w in v.items() if k not in without}
            return hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

        return s.map(one)

    return digest(c)


def flatten(value: object, prefix: str = "") -> dict[str, str]:
    """Nested JSON as dotted names; lists of scalars are joined."""
    out: dict[str, str] = {}
    if isinstance(value, dict):
        for k, v in value.items():
            out |= flatten(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        plain = [str(x) for x in value if isinstance(x, (str, int, float)) and not isinstance(x, bool)]
        if plain:
            out[prefix] = ", ".join(plain)
        for i, x in enumerate(value):
            if isinstance(x, dict):
                out |= flatten(x, f"{prefix}.{i}")
    elif value is not None:
        out[prefix] = str(value)
    return out


def reply_fields(c: Column) -> Column:
    """R2: the six fields of a reply in whatever nesting and names; of several values the longest wins; '' for none. ISO dates turn day first."""
    names = {a: f for f, all_ in ALIASES.items() for a in all_}

    def one(x):
        try:
            flat = flatten(json.loads(x))
        except (TypeError, ValueError):
            flat = {}
        out = dict.fromkeys(FIELDS, "")
        for k, v in flat.items():
            low = k.lower().replace(" ", "_")
            f = names.get(k) or names.get(low) or next((names[x] for x in reversed(k.split(".")) if x in names), None)
            v = v.strip()
            if f and len(v) > len(out[f]):
                out[f] = v
        out["so_hieu"] = "".join(out["so_hieu"].split())
        if m := _ISO.match(out["ngay_ban_hanh"]):
            out["ngay_ban_hanh"] = "/".join(reversed(m.groups()))
        return out

    @F.pandas_udf(", ".join(f"{f} string" for f in FIELDS))
    def fields(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in s], columns=list(FIELDS))

    return fields(c)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: Column, tables: bool = False) -> Column:
    """The paragraphs of a word-processor file, with cells of tables marked where asked; NULL for anything else."""

    def one(b):
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(b)).read("word/document.xml"))
        except Exception:  # noqa: BLE001
            return None
        said = lambda e: "".join(t.text or "" for t in e.iter(_W + "t"))
        inside = {p for t in root.iter(_W + "tbl") for p in t.iter(_W + "p")}
        out = [s for p in root.iter(_W + "p") if p not in inside and (s := said(p)).strip()]
        if tables:
            out += ["[TABLE] " + s for c in root.iter(_W + "tc") if (s := said(c)).strip()]
        return "\n".join(out)

    @F.pandas_udf("string")
    def texts(s: pd.Series) -> pd.Series:
        return s.map(one)

    return texts(content)


def bootstrap_exact(df: DataFrame, group: str, value: str, iterations: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by resampling with a seeded generator, exactly; groups are of metric rows, one per document and field."""
    if iterations < 1 or not 0 < confidence < 1:
        raise ValueError("iterations must be positive and confidence between 0 and 1")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].dropna().sort_values().tolist()
        if not v:
            lo = hi = mean = None
        elif len(v) == 1:
            lo = hi = mean = v[0]
        else:
            r = random.Random(seed)
            means = sorted(sum(v[r.randrange(len(v))] for _ in v) / len(v) for _ in range(iterations))
            lo, hi = np.percentile(means, [50 * (1 - confidence), 50 * (1 + confidence)])
            mean = sum(v) / len(v)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [len(v)], "mean": [mean], "lower": [lo], "upper": [hi]})

    kind = df.schema[group].dataType.simpleString()
    t = df.select(F.col(group).alias("k"), F.col(value).cast("double").alias("value"))
    return t.groupBy("k").applyInPandas(one, f"k {kind}, n long, mean double, lower double, upper double").withColumnRenamed("k", group)


def mask_agreement(pred: Column, truth: Column) -> Column:
    """Mean squared and summed absolute error, IoU and Dice of two flat masks of values in [0, 1]."""

    @F.pandas_udf("mse double, sad double, iou double, dice double")
    def agree(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x, y = np.asarray(x, float), np.asarray(y, float)
            p, q = x > 0.5, y > 0.5
            both, any_ = (p & q).sum(), (p | q).sum()
            rows.append((((x - y) ** 2).mean(), np.abs(x - y).sum(), both / any_ if any_ else 1.0, 2 * both / (p.sum() + q.sum()) if p.sum() + q.sum() else 1.0))
        return pd.DataFrame(rows, columns=["mse", "sad", "iou", "dice"])

    return agree(pred, truth)


def red_matting(pixels: Column) -> Column:
    """Stamps out of flat RGB pixels: alpha from the red excess, white where it is strong. Bytes in, bytes out."""

    @F.pandas_udf("binary")
    def clean(s: pd.Series) -> pd.Series:
        def one(b):
            p = np.frombuffer(b, np.uint8).reshape(-1, 3).astype(np.float32)
            alpha = np.clip((p[:, 0] - np.maximum(p[:, 1], p[:, 2]) - 15) / 35, 0, 1)
            out = p * (1 - alpha[:, None]) + 255 * alpha[:, None]
            out[alpha * 255 > 20] = 255
            return out.astype(np.uint8).tobytes()

        return s.map(one, na_action="ignore")

    return clean(pixels)

"""Damage-tolerant word shingles of a text, shared by the similarity joins.

A text counts as its runs of three consecutive words (runs of letters and digits, case ignored), taken after the damage of
page scans and of odd characters is set aside: words cut at line ends are joined, page numbers and running headers of
hard-wrapped texts left out, odd characters made consistent, and each word folded so that common misreadings of it agree.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BARE_LETTERS, Cache, h64, mix, written
from .confusables import consistent, odd_flags
from .ocr_repair import clean_lines, is_scan

K = 3
_FOLD = {o: c.lower() for o, c in BARE_LETTERS.items()} | {ord(a): b for a, b in zip("l1906f(yj", "iigobtcvi")}
_OTHER = re.compile(r"[\W_]+")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fold_word(raw: str) -> int:
    """A stable hash of a token's word under which misreadings agree; 0 for none. Numbers keep their digits."""
    t = raw.strip(".!?\"“”‘’)[]…'_*")
    if t[:1] == "(" and (len(t) < 2 or not t[1].islower()):
        t = t[1:]
    if not any(c.isalpha() for c in t):
        t = _OTHER.sub("", t)
        return _signed(h64(t)) if t else 0
    t = t.lower().translate(_FOLD)
    # the letters that are misread as several are written as those
    for a, b in (("h", "ii"), ("u", "ii"), ("m", "rri"), ("n", "ri"), ("d", "ci")):
        t = t.replace(a, b)
    return _signed(h64("w" + _OTHER.sub("", t)))


WORDS = Cache(fold_word)


def tokens(text: str, odd: bool) -> list[str]:
    """The tokens of a text with the damage of pages set aside."""
    text = consistent(text, odd)
    if "\n" in text:
        lines = text.split("\n")
        if is_scan(lines):
            text = "\n".join(clean_lines(text))
    for c in "/-:;,":
        if c in text:
            text = text.replace(c, " ")
    return text.split()


def column_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """batch_features() of an Arrow column of texts."""
    return batch_features(column.to_pylist(), odd_flags(column))


def batch_features(texts: list[str | None], odd: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of many texts, end to end, and the offsets of each text's."""
    get = WORDS.__getitem__
    parts = [np.fromiter(map(get, tk), np.int64, len(tk)) for tk in (tokens(t, o) if t else [] for t, o in zip(texts, odd))]
    n = np.array([len(p) for p in parts], dtype=np.int64)
    words = np.concatenate(parts).view(np.uint64) if parts else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(parts)), n)
    keep = words != 0
    words, doc = words[keep], doc[keep]
    n = np.bincount(doc, minlength=len(parts))
    ends = np.cumsum(n)
    short = [int(i) for i in np.flatnonzero((n > 0) & (n < K))]
    h = words * np.uint64(0x9E3779B97F4A7C15)
    h = h[: max(0, len(words) - K + 1)]
    for j in range(1, K):
        h = mix(h + words[j : len(words) - K + 1 + j] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * j))
    d = doc[: len(h)]
    inside = d == doc[K - 1 :] if len(h) else np.empty(0, bool)
    h, d = h[inside], d[inside]
    if short:  # a text of fewer words is one run
        extra = np.array([int(mix(np.array([np.bitwise_xor.reduce(mix(words[ends[i] - n[i] : ends[i]] + np.arange(n[i], dtype=np.uint64)))]))[0]) for i in short], dtype=np.uint64)
        h, d = np.concatenate([h, extra]), np.concatenate([d, np.array(short)])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    m = np.bincount(d, minlength=len(parts))
    o = np.concatenate([[0], np.cumsum(m)])
    for i in range(len(parts)):
        h[o[i] : o[i + 1]].sort()
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[first], d[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(parts)))])


def features(text: str, odd: bool = True) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    return batch_features([text], [odd])[0]


def set_ids(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """A hash of each whole set: equal sets have equal ids. 0 for an empty set."""
    n = np.diff(o)
    x = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        x[full] = np.add.reduceat(mix(h), o[:-1][full])
        x[full] = mix(x[full] + n[full].astype(np.uint64)) | np.uint64(1)
    return x.view(np.int64)


def read_features(df: DataFrame, text: str, *others: str) -> DataFrame:
    """The columns (others…, text) of the rows with a text."""
    return df.where(F.col(text).isNotNull()).select(*others, F.col(text).alias("text"))


def chunks(batches, size: int = 2000):
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def narrow(h: np.ndarray) -> np.ndarray:
    """Shingle hashes as 32-bit ones: within one pair of texts a false match has a chance below n² / 4e9."""
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def feature_sets(df: DataFrame, key: str, text: str, share: float) -> DataFrame:
    """The one pass over the texts, written to the shared folder: (id, fp, s) per row with a text, fp its set id (0: no word)
    and s its sorted features, NULL where the task has met the set before; and (x, n) for the features frequent among the
    distinct sets of a task.

    A feature frequent overall is frequent in some task (Savasere's partition argument), so each task reports only its
    own frequent ones; their number is at most the mean text's features divided by share, however many rows there are.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = n = 0
        keys, counts = np.empty(0, np.int32), np.empty(0, np.int64)

        def merged():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            k2, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            return k2, np.bincount(at, np.concatenate([counts, c])).astype(np.int64)

        names = ["id", "fp", "s", "x", "n"]
        id_type = None
        for b in chunks(batches):
            id_type = b.schema.field(0).type
            h, o = column_features(b.column(1))
            fp = set_ids(h, o)
            new = np.zeros(len(fp), bool)
            for j, f in enumerate(fp.tolist()):
                if f and f not in seen:
                    seen.add(f)
                    new[j] = True
            if len(seen) > 5_000_000:
                seen.clear()
            n += int(new.sum())
            v = narrow(h)
            held.append(v[np.repeat(new, np.diff(o))])
            size += len(held[-1])
            if size > 4_000_000:
                keys, counts = merged()
                held, size = [], 0
                if len(keys) > 8_000_000:  # what has been rare in all of so much isn't frequent in this task
                    keep = counts > max(1, share * n / 4)
                    keys, counts = keys[keep], counts[keep]
            sets = pa.array([np.sort(v[o[i] : o[i + 1]]).tobytes() if new[i] else None for i in range(len(fp))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), sets, pa.nulls(len(fp), pa.int32()), pa.nulls(len(fp), pa.int64())], names)
        if held:
            keys, counts = merged()
        keep = counts >= max(3, share * n / 2)
        if id_type is not None:
            k = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(keys[keep]), pa.array(counts[keep])], names)

    return written(read_features(df, text, key).mapInArrow(run, f"id {kind}, fp long, s binary, x int, n long"), "features")


def frequent_features(table: DataFrame, share: float, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in more than about this share of the texts, sorted, and their counts; of bounded number."""
    found = table.where("x IS NOT NULL").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4, share * rows)).collect()
    found.sort(key=lambda r: r.x)
    return np.array([r.x for r in found], dtype=np.int32), np.array([r.n for r in found], dtype=np.int64)


def in_sorted(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each of s is in the sorted array table."""
    if not len(table) or not len(s):
        return np.zeros(len(s), bool)
    at = np.searchsorted(table, s)
    at[at == len(table)] = 0
    return table[at] == s

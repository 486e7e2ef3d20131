"""Splitting oversized items at natural boundaries: content-defined chunking.

Method: a rolling hash over the characters marks landmarks; a piece ends at the first landmark after its minimum size,
snapped to the nearest natural boundary (line end, sentence end, word end, in this order of preference within the snap
window), and no later than the maximum size allows. Landmarks depend only on nearby characters, so an edit alters the
pieces around it and the cuts fall together again after it. Each piece begins with the last characters of the one before,
cut back to the beginning of a word.

Defined results: NULL gives no piece; a text of at most max_size characters, the empty one too, is one piece. A run without
white space longer than a piece is cut by force, and pieces ending so are marked. Sizes are code points of the text as stored.
Pieces without their repeated beginnings make up the whole text. Repeated rows are cut alike. Extra columns are dropped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX, MIN, OVERLAP = 2000, 900, 200
WINDOW = 24  # characters the rolling hash covers
MASK = np.uint64(0xFF)  # a landmark every 256 characters in the mean
SNAP = 160  # a landmark moves at most so far to a boundary

_WORD_END = re.compile(r"\S(?=\s)")
_SPACE = re.compile(r"\s")


def landmarks(text: str) -> np.ndarray:
    """The positions behind which a landmark lies, ascending."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = (c + np.uint64(0x9E3779B9)) * np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    h = np.zeros(len(c), np.uint64)
    for j in range(min(WINDOW, len(c))):  # the window's hash: each character times its power
        power = np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        h[j:] += c[: len(c) - j] * power
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(40)) & MASK == 0) + 1


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of words, as positions behind the word, and their rank: 3 line ends, 2 sentence ends, 1 word ends."""
    at = np.fromiter((m.end() for m in _WORD_END.finditer(text)), np.int64)
    rank = np.array([3 if text[i] in "\n\r\x0b\x0c\x85  " else 2 if text[i - 1] in ".!?;…" or (text[i - 1] in ")”\"’" and i > 1 and text[i - 2] in ".!?…") else 1 for i in at.tolist()], dtype=np.int64)
    return at, rank


def cut(text: str, most: int = MAX, least: int = MIN, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(begin, end, forced) of each piece."""
    n = len(text)
    if n <= most:
        return [(0, n, False)]
    marks = landmarks(text)
    at, rank = boundaries(text)
    pieces: list[tuple[int, int, bool]] = []
    begin = fresh = 0  # where the piece begins, and where its new text does
    while True:
        if n - begin <= most:
            pieces.append((begin, n, False))
            return pieces
        high = begin + most
        lo, hi = np.searchsorted(at, fresh, "right"), np.searchsorted(at, high, "right")
        if lo == hi and begin < fresh:  # a long word follows: give up the overlap, and leave the white space before it behind
            begin = fresh
            while begin < n and begin - pieces[-1][0] < most and _SPACE.match(text[begin]):
                begin += 1
            pieces[-1] = (pieces[-1][0], begin, pieces[-1][2])
            fresh = begin
            continue
        if lo == hi:
            gap = next((i for i in range(high, fresh, -1) if _SPACE.match(text[i - 1])), 0)
            end = gap or high
            forced = not gap and not _SPACE.match(text[end])
        else:
            forced = False
            i = np.searchsorted(marks, max(fresh, begin + least))
            mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
            a, b = np.searchsorted(at, max(fresh + 1, mark - SNAP)), np.searchsorted(at, min(high, mark + SNAP), "right")
            a = max(a, lo)
            if a < b:  # the best kind of boundary near the landmark, the nearest of these
                near = rank[a:b] == rank[a:b].max()
                spots = at[a:b][near]
                end = int(spots[np.argmin(np.abs(spots - mark))])
            else:
                end = int(at[hi - 1] if mark >= at[hi - 1] else at[np.searchsorted(at, mark)])
        pieces.append((begin, end, forced))
        fresh = end
        begin = max(0, end - overlap)
        if begin < end and begin > 0 and not _SPACE.match(text[begin - 1]):  # not within a word
            m = _SPACE.search(text, begin, end)
            begin = m.end() if m else (begin if forced else end)


def pieces(df: DataFrame, key: str, text: str, most: int = MAX, least: int = MIN, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, begin, end, forced, text) of every row; narrow, whatever the number of rows."""
    if not 0 <= overlap < least < most:
        raise ValueError("sizes must be overlap < least < most")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                idx, no, b, e, f, x = [], [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    if t is None:
                        continue
                    for k, (p, q, forced) in enumerate(cut(t, most, least, overlap)):
                        idx.append(i)
                        no.append(k)
                        b.append(p)
                        e.append(q)
                        f.append(forced)
                        x.append(t[p:q])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(idx, pa.int64())), pa.array(no, pa.int32()), pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(f, pa.bool_()), pa.array(x, pa.string())], ["k", "piece", "begin", "end", "forced", "text"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, begin int, end int, forced boolean, text string")


def oversized(df: DataFrame, key: str, text: str, most: int = MAX) -> DataFrame:
    """(key, forced) of the rows whose text is longer than a piece; forced is 1 where a run of it had to be cut."""
    long = df.where(F.length(text) > most)
    return pieces(long, key, text, most).groupBy(key).agg(F.max(F.col("forced").cast("long")).alias("forced"))

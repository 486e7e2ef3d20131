"""Evaluation texts leaking into training text: CGK random-walk embedding and bit-sampling LSH.

Method: the items' windows of WINDOW consecutive words, and the documents' windows of WINDOW words and up to EDITS fewer or
more, are embedded by the random walk of Chakraborty, Goldenberg and Koucký: a pointer runs over the window, one symbol is
put out at each of three times as many steps, and the step's hash of the symbol says whether the pointer moves on. Windows
at a small edit distance so get embeddings at a small Hamming distance, equal windows equal ones. Each repetition has a walk
of its own and samples SAMPLED symbols of its embedding as a key; windows that meet under a key of any repetition are
verified exactly by their edit distance in words. Windows of documents can only be within a number of edits of an item's if
enough of their word pairs are pairs of items (the q-gram lemma), so only those are embedded.

Recall: equal windows always meet, under any one key, so a search without edits has one repetition. A window with one word
substituted, inserted or deleted meets its twin with a chance above 0.97 (measured in the tests, whatever the place).

Scale: one narrow pass over the documents for each block of items, of at most BLOCK_BYTES as broadcast; equal windows of
items are one. Nothing is shuffled but the matches.

Defined results: NULL and blank texts match nothing. An item of fewer than WINDOW words is one window of its own length; it must stand there whole.
Case, accents, punctuation, spacing and line breaks don't count. Repeated items are matched alike. Texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, strip_marks
from .pooled import Pooled

WINDOW = 12
EDITS = 1
REPEATS, SAMPLED = 16, 4
BLOCK_BYTES = 128 << 20  # of a block of items as it is broadcast, at most; a longer single item is a block of its own
_RUNS = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_BITS = 20


def words_of(token: str) -> list[str]:
    t = strip_marks(_FORMAT.sub("", token) if not token.isascii() else token).casefold()
    return _RUNS.findall(strip_marks(t))


def embed(w: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """The CGK embeddings of windows (rows of word numbers) by the walk of a seed; 0 once a window has run out."""
    n, k = w.shape
    out = np.zeros((n, steps), np.int64)
    at = np.zeros(n, np.int64)
    row = np.arange(n)
    for j in range(steps):
        live = at < k
        x = np.where(live, w[row, np.minimum(at, k - 1)], 0)
        out[:, j] = x
        at += live & (mix((x * steps + j + seed * 7919).astype(np.uint64)) >> np.uint64(63)).astype(bool)
    return out


def keys(w: np.ndarray, window: int, repeats: int) -> np.ndarray:
    """A key of each window for each repetition."""
    rng = np.random.default_rng(20)
    out = np.empty((repeats, len(w)), np.uint64)
    for r in range(repeats):
        # late symbols are often past the window's end, so samples are taken where windows still run
        sample = sorted(rng.choice(2 * window, min(SAMPLED, 2 * window), replace=False).tolist())
        e = embed(w, r + 1, sample[-1] + 1)
        h = np.full(len(w), r + 1, np.uint64)
        for p in sample:
            h = mix(h * np.uint64(31) + e[:, p].astype(np.uint64) + np.uint64(p))
        out[r] = h
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact edit distances in words of pairs of windows (rows of a and b), all pairs at once."""
    n, k, m = len(a), a.shape[1], b.shape[1]
    row = [np.full(n, j, np.int32) for j in range(m + 1)]
    for i in range(1, k + 1):
        new = [np.full(n, i, np.int32)]
        for j in range(1, m + 1):
            new.append(np.minimum(np.minimum(row[j], new[-1]) + 1, row[j - 1] + (a[:, i - 1] != b[:, j - 1])))
        row = new
    return row[m]


def _rows_hash(w: np.ndarray) -> np.ndarray:
    h = np.full(len(w), w.shape[1], np.uint64)
    for j in range(w.shape[1]):
        h = mix(h * np.uint64(31) + w[:, j].astype(np.uint64))
    return h


def _spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, place) for every place from a[i] to b[i]."""
    m = b - a
    return np.repeat(np.arange(len(m)), m), np.repeat(a, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)


class Windows:
    """The distinct windows of one length, and the items that have each."""

    def __init__(self, w: np.ndarray, owner: np.ndarray, window: int, repeats: int):
        h = _rows_hash(w)
        order = np.lexsort((owner, *w.T[::-1], h))
        w, owner, h = w[order], owner[order], h[order]
        new = np.r_[True, (w[1:] != w[:-1]).any(axis=1)] if len(w) else np.empty(0, bool)
        self.w = w[new].astype(np.int32)
        at = np.cumsum(new) - 1
        keep = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])] if len(w) else new
        self.owner = owner[keep]
        self.begin = np.searchsorted(at[keep], np.arange(len(self.w) + 1))
        k = keys(self.w.astype(np.int64), window, repeats) if len(self.w) else np.empty((repeats, 0), np.uint64)
        self.order = np.argsort(k, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(k, self.order, 1)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.w, self.owner, self.begin, self.order, self.keys))

    def near(self, w: np.ndarray, window: int, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of a row of w, index of a window, edit distance) of the pairs that meet and are near."""
        k = keys(w, window, len(self.keys))
        met = []
        for r in range(len(self.keys)):
            i, place = _spread(np.searchsorted(self.keys[r], k[r], "left"), np.searchsorted(self.keys[r], k[r], "right"))
            met.append(i * len(self.w) + self.order[r, place])
        met = np.unique(np.concatenate(met))
        out = []
        for s in range(0, len(met), 100_000):
            i, q = np.divmod(met[s : s + 100_000], len(self.w))
            d = edit_distances(w[i], self.w[q])
            good = d <= edits
            out.append((i[good], q[good], d[good]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3


class Items:
    """A block of items: vocabulary, pairs, and the LSH tables of their windows."""

    def __init__(self, rows: list[tuple[int, str]], window: int, edits: int):
        self.window, self.edits = window, edits
        self.vocabulary: dict[str, int] = {}
        wins: dict[int, list] = {}
        pairs = []
        for item, text in sorted(rows, key=lambda r: r[0]):
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for t in (text or "").split() for x in words_of(t)], dtype=np.int64)
            if not len(w):
                continue
            pairs.append(w[:-1] << 32 | w[1:])
            v = np.lib.stride_tricks.sliding_window_view(w, min(len(w), window))
            wins.setdefault(v.shape[1], []).append((v, np.full(len(v), item)))
        # items of fewer words than a window stand whole or not at all
        self.tables = {m: Windows(np.concatenate([v for v, _ in x]), np.concatenate([o for _, o in x]), m, REPEATS if edits and m == window else 1) for m, x in wins.items()}
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(mix(self.pairs.astype(np.uint64)) >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def is_pair(self, k: np.ndarray) -> np.ndarray:
        maybe = self.bitmap[(mix(k.astype(np.uint64)) >> np.uint64(64 - _BITS)).astype(np.int64)]
        at = np.flatnonzero(maybe)
        if len(at) and len(self.pairs):
            i = np.minimum(np.searchsorted(self.pairs, k[at]), len(self.pairs) - 1)
            maybe[at] = self.pairs[i] == k[at]
        return maybe

    def matches(self, x: np.ndarray, o: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text index, item, least edits, windows that match) for many texts end to end."""
        doc = np.repeat(np.arange(len(o) - 1), np.diff(o))
        pair = self.is_pair(x[:-1] << 32 | x[1:]) & (x[:-1] > 0) & (x[1:] > 0) & (doc[1:] == doc[:-1]) if len(x) > 1 else np.empty(0, bool)
        c = np.r_[0, np.cumsum(pair)]
        best: dict[tuple[int, int], list[int]] = {}
        for m, table in self.tables.items():
            edits = self.edits if m == self.window else 0
            for n in range(max(1, m - edits), m + edits + 1):
                if len(x) < n:
                    continue
                hits = c[n - 1 : len(x)] - c[: len(x) - n + 1]
                enough = (hits >= n - 1 - 2 * edits) & (doc[n - 1 :] == doc[: len(x) - n + 1])
                use = np.flatnonzero(enough & (x > 0) if n == 1 else enough)
                for lo in range(0, len(use), 50_000):
                    at = use[lo : lo + 50_000]
                    i, q, d = table.near(np.lib.stride_tricks.sliding_window_view(x, n)[at], m, edits)
                    # a document and a window first, the window's items then
                    key, back = np.unique(doc[at[i]] * len(table.w) + q, return_inverse=True)
                    least, times = np.full(len(key), edits, np.int64), np.bincount(back, minlength=len(key))
                    np.minimum.at(least, back, d)
                    j, place = _spread(table.begin[key % max(1, len(table.w))], table.begin[key % max(1, len(table.w)) + 1])
                    for t, item, e, k in zip((key[j] // max(1, len(table.w))).tolist(), table.owner[place].tolist(), least[j].tolist(), times[j].tolist()):
                        b = best.setdefault((t, item), [e, 0])
                        b[0] = min(b[0], e)
                        b[1] += k
        return [(t, item, e, k) for (t, item), (e, k) in best.items()]


def blocks(items: DataFrame, item_key: str, item_text: str, repeats: int):
    """The items in blocks of bounded size: a word takes its number and place in a window, its keys, and its pair."""
    most = BLOCK_BYTES // (4 * WINDOW + 12 * repeats + 60)
    held, size = [], 0
    for r in items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(item_key, item_text).orderBy(item_key).toLocalIterator():
        n = r[1].count(" ") + r[1].count("\n") + 1
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    yield held


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, edits: int = EDITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep…, item, edits, windows): documents that hold a passage of an item, with the least edit distance of a window and the number of windows."""
    out = None
    cols = (key, *keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols) + f", `{item_key}` {items.schema[item_key].dataType.simpleString()}, edits int, windows int"
    for block in blocks(items, item_key, item_text, REPEATS if edits else 1):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, window, edits))

        def run(batches, shared=shared):
            it = shared.value
            pool = Pooled(lambda t: [it.vocabulary.get(w, 0) for w in words_of(t)])
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    b = batch.slice(lo, 2000)
                    x, o = pool.arrays(b.column(len(cols)).to_pylist())
                    got = it.matches(x, o)
                    if got:
                        i, item, e, n = zip(*got)
                        idx = pa.array(i, pa.int64())
                        yield pa.RecordBatch.from_arrays([*[c.take(idx) for c in b.columns[: len(cols)]], pa.array(item), pa.array(e, pa.int32()), pa.array(n, pa.int32())], [*cols, item_key, "edits", "windows"])

        one = docs.where(F.col(text).isNotNull()).select(*cols, text).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): every document that holds WINDOW consecutive words of an item."""
    return leaks(docs, items, edits=0).select("doc_id", "item_id").distinct()


def near(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits): every document that holds WINDOW words of an item with at most EDITS words substituted, inserted or deleted."""
    return leaks(docs, items).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(eval_split, task, source, n_items, n_docs): leaked items and the documents they leaked into."""
    l = leaks(docs, items, edits=0, keep=("source",)).join(items.select("item_id", "eval_split", "task"), "item_id")
    return l.groupBy("eval_split", "task", "source").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"))

"""Abusive, hateful or sexual content: maximum-scoring segments of token log-odds.

Method: words, word pairs and triples have the log-odds of the flagged texts of a category against the corpus and the texts
flagged for other categories, with an informative Dirichlet prior from the counts of the whole corpus. The score of a
place in a text is the mean of the three that end there, less a drift. A linear scan finds the maximum-scoring segment of
every text and category, and all significant ones where there is any. Segment scores become expectations by extreme-value
statistics (Karlin and Altschul): E = K · length · exp(-λ · score); the greatest E that counts is set by held-out labels.

Words are taken as they read: letters set apart by points, dashes or blanks are joined, digits and signs in place of
letters read as those, drawn-out letters shortened, marks and case left out.

Scale: two narrow passes over the corpus, one for counts, one for scores. Counts are summed in arrays of fixed size within
each task, then in a tree. The labelled sample is bounded by LABELS documents (those of the smallest hashes), nothing else is.

Defined results: NULL, empty and blank texts score 0 in every category. With fewer than POSITIVES judged documents of a category
nothing is flagged for it. A text of any length is scanned whole. Repeated judgements count once; a text judged both flagged and not is flagged.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import h64, mix, strip_marks
from .pooled import Pooled

CATEGORIES = ("abuse", "hate", "sexual")
BUCKETS = 1 << 19  # of hashed words, pairs and triples each
LABELS = 20_000  # documents with labels that are used at most
PRIOR = 2000.0  # weight of the prior, in tokens
OTHERS = 0.3  # weight of the texts flagged for other categories in the reference
DRIFT = 0.35
LOWEST, HIGHEST = -2.0, 5.0  # log-odds are kept within
RANGE = 1 << 14
FAN_IN = 64  # tasks whose counts one task adds up
POSITIVES = 20  # with fewer judged documents of a category no cut can be set
CALM_WEIGHT = 5.0  # how much rarer than in the corpus unflagged texts are among the judged ones
LEAST = math.log(100)  # no passage counts that chance gives once in a hundred texts

_LEET = str.maketrans("@01345$!", "aoieassi")
_APART = re.compile(r"[^\W_](?:[.\-*_·][^\W_])+[.,!?;:]*$")
_PARTS = re.compile(r"[a-z0-9@$]+")
_DRAWN = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<!\w)(?:\w[ ]){2,}\w(?!\w)")


def words_of(token: str) -> list[str]:
    """The words of one token as they read."""
    t = strip_marks(token.lower())
    if len(t) > 3 and _APART.match(t):
        t = re.sub(r"[.\-*_·]", "", t)
    out = []
    for w in _PARTS.findall(t):
        if any(c.isalpha() for c in w):
            w = _DRAWN.sub(r"\1", w.translate(_LEET))
            w = w[0] + w[1:].replace("v", "u")
        else:
            w = "#"
        out.append(w)
    return out


def _numbers(token: str) -> list[int]:
    return [h64(w) >> 2 << 1 | (len(w) == 1 and w != "#") for w in words_of(token)]


def reading(pool: Pooled, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as numbers, end to end, with offsets; letters set apart by blanks are joined."""
    x, o = pool.arrays(texts)
    if len(x) > 2:
        one = (x & 1).astype(bool)
        doc = np.repeat(np.arange(len(texts)), np.diff(o))
        apart = np.unique(doc[2:][one[2:] & one[1:-1] & one[:-2] & (doc[2:] == doc[:-2])]).tolist()
        if apart:
            y, p = pool.arrays([_SPACED.sub(lambda m: m.group().replace(" ", ""), texts[i]) for i in apart])
            parts = [x[o[i] : o[i + 1]] for i in range(len(texts))]
            for k, i in enumerate(apart):
                parts[i] = y[p[k] : p[k + 1]]
            x = np.concatenate(parts)
            o = np.r_[0, np.cumsum([len(q) for q in parts])]
    return x.astype(np.uint64), o


def grams(x: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    """The buckets of the word, pair and triple that end at each place; 0 where a text has too few words before it."""
    doc = np.repeat(np.arange(len(o) - 1), np.diff(o))
    n = np.uint64(BUCKETS)
    m = mix(x)
    out = [(m % n).astype(np.int64)]
    for k in (2, 3):
        g = np.zeros(len(x), np.int64)
        if len(x) >= k:
            h = x[k - 1 :] * np.uint64(31 + 6 * (k - 2)) + (m[:-1] if k == 2 else mix(x[1:-1] + m[:-2] * np.uint64(7)))
            g[k - 1 :] = np.where(doc[k - 1 :] == doc[: len(x) - k + 1], (mix(h) % n).astype(np.int64), 0)
        out.append(g)
    return out


def _chunks(batches, size=1000):
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def corpus_counts(docs: DataFrame, text: str) -> list[np.ndarray]:
    """Counts of every bucket over all documents, for words, pairs and triples."""

    def count(batches):
        pool = Pooled(_numbers)
        total = np.zeros((3, BUCKETS), np.int32)
        for b in _chunks(batches):
            x, o = reading(pool, b.column(0).to_pylist())
            for k, g in enumerate(grams(x, o)):
                total[k] += np.bincount(g, minlength=BUCKETS).astype(np.int32)
        group = TaskContext.get().partitionId() // FAN_IN
        for k in range(3):
            for r in range(BUCKETS // RANGE):
                part = total[k, r * RANGE : (r + 1) * RANGE]
                if part.any():
                    yield blob(group, k * 4096 + r, part)

    def blob(group, at, counts):
        """Counts of one range; where most are zero, only the others with their places."""
        u = np.flatnonzero(counts)
        sparse = len(u) * 3 < len(counts)
        data = u.astype(np.int32).tobytes() + counts[u].astype(np.int64).tobytes() if sparse else counts.astype(np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([at], pa.int32()), pa.array([sparse]), pa.array([data], pa.binary())], ["grp", "at", "sparse", "counts"])

    def adder(whole: bool):
        def add(batches):
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for group, at, sparse, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    t = total.setdefault((0 if whole else group, at), np.zeros(RANGE, np.int64))
                    if sparse:
                        n = len(c) // 12
                        t[np.frombuffer(c, np.int32, n)] += np.frombuffer(c, np.int64, n, 4 * n)
                    else:
                        t += np.frombuffer(c, np.int64)
            for (group, at), t in total.items():
                yield blob(group, at, t)

        return add

    # a tree of partial sums: FAN_IN tasks of the corpus into one, then those of each range
    schema = "grp int, at int, sparse boolean, counts binary"
    some = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(count, schema).repartition("grp", "at").mapInArrow(adder(False), schema)
    got = some.repartition(3 * BUCKETS // RANGE, "at").mapInArrow(adder(True), schema).collect()
    out = np.zeros((3, BUCKETS), np.float64)
    for r in got:
        k, j = divmod(r["at"], 4096)
        c = r["counts"]
        n = len(c) // 12
        if r["sparse"]:
            out[k, j * RANGE + np.frombuffer(c, np.int32, n)] += np.frombuffer(c, np.int64, n, 4 * n)
        else:
            out[k, j * RANGE : (j + 1) * RANGE] += np.frombuffer(c, np.int64)
    return list(out)


class Counts:
    """Bucket counts of the labelled texts by set of texts and fold: flagged at all, and flagged for each category."""

    def __init__(self):
        self.of = {(s, f): np.zeros((3, BUCKETS)) for s in ("any", *CATEGORIES) for f in (0, 1)}


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, flags, fold) of the judged documents: a bit for each category; at most LABELS of them."""
    bits = F.lit(0)
    for i, c in enumerate(CATEGORIES):
        bits = F.when(F.col("category") == c, 1 << i).otherwise(bits)
    per = labels.where("category IS NOT NULL").groupBy(key).agg(F.bit_or(bits).alias("flags"))
    per = per.orderBy(F.xxhash64(key), key).limit(LABELS).withColumn("fold", F.pmod(F.xxhash64(F.lit(7), key), F.lit(2)).cast("int"))
    return docs.select(key, text).join(F.broadcast(per), key).select(key, text, F.col("flags").cast("int").alias("flags"), "fold")


def label_counts(judged: DataFrame, text: str) -> Counts:
    def count(batches):
        pool = Pooled(_numbers)
        for b in _chunks(batches):
            flags, fold = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            x, o = reading(pool, b.column(0).to_pylist())
            n = np.diff(o)
            rows = []
            for k, g in enumerate(grams(x, o)):
                for s, name in enumerate(("any", *CATEGORIES)):
                    for f in (0, 1):
                        use = np.repeat((flags > 0 if s == 0 else flags & (1 << (s - 1)) > 0) & (fold == f), n)
                        u, c = np.unique(g[use], return_counts=True)
                        if len(u):
                            rows.append((k, name, f, u.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], ["k", "name", "fold", "u", "c"])

    out = Counts()
    for r in judged.select(text, "flags", "fold").mapInArrow(count, "k int, name string, fold int, u binary, c binary").toLocalIterator():
        out.of[r["name"], r["fold"]][r["k"]][np.frombuffer(r["u"], np.int32)] += np.frombuffer(r["c"], np.int32)
    return out


def log_odds(corpus: list[np.ndarray], hit: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket in the texts of a category against the reference, for words, pairs and triples."""
    out = np.empty((3, BUCKETS), np.float32)
    for k in range(3):
        p = corpus[k] / max(corpus[k].sum(), 1.0)
        ref = p + OTHERS * other[k] / max(other[k].sum(), 1.0)
        ref /= max(ref.sum(), 1e-9)
        a = p * PRIOR + 1e-3
        y, n, r = hit[k], hit[k].sum(), 1e6
        out[k] = np.log((y + a) / (n + PRIOR - y - a)) - np.log((ref * r + a) / (r + PRIOR - ref * r - a))
    return out


def places(tables: np.ndarray, g: list[np.ndarray]) -> np.ndarray:
    return np.clip((tables[0][g[0]] + tables[1][g[1]] + tables[2][g[2]]) / 3, LOWEST, HIGHEST).astype(np.float64) - DRIFT


def best_segments(s: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The score of the maximum-scoring segment of each text, 0 at least."""
    n = np.diff(o)
    out = np.zeros(len(n))
    if not len(s):
        return out
    doc = np.repeat(np.arange(len(n)), n) * 1e7  # each text starts anew below all before it
    c = np.r_[0.0, np.cumsum(s)]
    low = np.minimum.accumulate(c[:-1] - doc)
    full = np.flatnonzero(n > 0)
    out[full] = np.maximum(0, np.maximum.reduceat((c[1:] - doc) - low, o[:-1][full]))
    return out


def all_segments(s: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of one sequence in linear time (Ruzzo and Tompa): (begin, end, score)."""
    found: list[list[float]] = []  # begin, end, sum before, sum up to the end
    total = 0.0
    for i, x in enumerate(s):
        before, total = total, total + x
        if x <= 0:
            continue
        cur = [i, i + 1, before, total]
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j -= 1
            if j < 0 or found[j][3] >= cur[3]:
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:]
        found.append(cur)
    return [(int(a), int(b), r - le) for a, b, le, r in found]


def extreme_values(scores: np.ndarray, n: np.ndarray, lam: float) -> float:
    """K of the extreme-value distribution with this λ, from the best scores of unflagged texts of n words."""
    use = n > 0
    return float(use.sum() / max((n[use] * np.exp(-lam * scores[use])).sum(), 1e-12)) if use.any() else 1.0


def karlin_lambda(scores: np.ndarray) -> float:
    """The positive solution of mean(exp(λ s)) = 1 over the background's place scores."""
    if not len(scores) or scores.max() <= 0 or scores.mean() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while np.exp(hi * scores).mean() < 1 and hi < 50:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.exp(mid * scores).mean() < 1 else (lo, mid)
    return (lo + hi) / 2


class Model:
    """Tables, extreme-value parameters and cut of each category."""

    def __init__(self, tables, lam, k, cut):
        self.tables, self.lam, self.k, self.cut = tables, lam, k, cut

    def surprise(self, c: int, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-ln E of segment scores in texts of n words."""
        return np.where(s > 0, self.lam[c] * s - np.log(self.k[c] * np.maximum(n, 1)), -np.log(self.k[c] * np.maximum(n, 1) + 1))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Counts of the whole corpus and of the labelled sample; λ, K and cuts from each fold scored by the other's tables."""
    corpus = corpus_counts(docs, text)
    judged = labelled(docs, labels, key, text)
    counts = label_counts(judged, text)
    half, whole = [], []
    for c in CATEGORIES:
        of = [(counts.of[c, f], counts.of["any", f] - counts.of[c, f]) for f in (0, 1)]
        half.append([log_odds(corpus, *of[1 - f]) for f in (0, 1)])  # by the fold to be scored
        whole.append(log_odds(corpus, of[0][0] + of[1][0], of[0][1] + of[1][1]))
    shared = docs.sparkSession.sparkContext.broadcast(np.array(half))

    def score(batches):
        pool = Pooled(_numbers)
        h = shared.value
        for b in _chunks(batches):
            flags, fold = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            x, o = reading(pool, b.column(0).to_pylist())
            g, n = grams(x, o), np.diff(o)
            cols = []
            for c in range(len(CATEGORIES)):
                s = np.zeros(len(x))
                hist = []
                for f in (0, 1):
                    p = places(h[c, f], g)
                    use = np.repeat(fold == f, n)
                    s[use] = p[use]
                calm = s[np.repeat(flags == 0, n)]
                hist = np.histogram(calm, 200, (LOWEST - 1, HIGHEST + 1))[0].tolist()
                cols += [pa.array(best_segments(s, o)), pa.array([hist] + [None] * (len(n) - 1), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n.astype(np.int64)), *cols], names)

    names = ["flags", "n"] + [x for i in range(len(CATEGORIES)) for x in (f"s{i}", f"h{i}")]
    schema = "flags int, n long, " + ", ".join(f"s{i} double, h{i} array<long>" for i in range(len(CATEGORIES)))
    rows = judged.select(text, "flags", "fold").mapInArrow(score, schema).collect()
    flags, n = np.array([r.flags for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=np.float64)
    lam, k, cut = [], [], []
    mids = np.linspace(LOWEST - 1, HIGHEST + 1, 201)[:-1] + (HIGHEST - LOWEST + 2) / 400
    for i in range(len(CATEGORIES)):
        s = np.array([r[f"s{i}"] for r in rows], dtype=np.float64)
        hist = np.sum([np.array(r[f"h{i}"]) for r in rows if r[f"h{i}"] is not None], axis=0) if rows else np.zeros(200)
        weight = np.atleast_1d(hist).astype(np.int64)
        sample = np.repeat(mids, np.minimum(weight, 10**9) * 100_000 // max(1, weight.sum())) if weight.sum() else np.empty(0)
        lam.append(karlin_lambda(sample))
        calm = flags == 0
        k.append(extreme_values(s[calm], n[calm], lam[-1]))
        y = flags & (1 << i) > 0
        e = lam[-1] * s - np.log(k[-1] * np.maximum(n, 1))
        cut.append(best_cut(e, y))
    return Model(np.array(whole), lam, k, cut)


def best_cut(e: np.ndarray, y: np.ndarray) -> float:
    """The cut of the greatest F1 on held-out labels, in the middle of its gap, where each unflagged text stands for
    CALM_WEIGHT, as flagged ones are over-represented among the judged; infinite with
    fewer positives than POSITIVES, so that nothing is flagged."""
    if y.sum() < POSITIVES:
        return math.inf
    order = np.argsort(-e, kind="stable")
    tp = np.cumsum(y[order])
    f1 = 2 * tp / (tp + CALM_WEIGHT * np.cumsum(~y[order]) + y.sum())
    at = int(f1.argmax())
    below = e[order[at + 1]] if at + 1 < len(e) else e[order[at]] - 2
    return max(LEAST, float((e[order[at]] + below) / 2))


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), model: Model | None = None) -> DataFrame:
    """(key, keep…, and for each category its score, -ln E of the best segment, whether it is flagged, and the number of its significant passages) of every document."""
    model = model or fit(docs, labels, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"{c} double, {c}_flag boolean, {c}_passages int" for c in CATEGORIES)
    cols = (key, *keep)

    def run(batches):
        m = shared.value
        pool = Pooled(_numbers)
        for b in _chunks(batches):
            x, o = reading(pool, b.column(len(cols)).to_pylist())
            g, n = grams(x, o), np.diff(o)
            out = []
            for c in range(len(CATEGORIES)):
                p = places(m.tables[c], g)
                e = m.surprise(c, best_segments(p, o), n)
                flag = e >= m.cut[c]
                count = np.zeros(len(n), np.int32)
                for i in np.flatnonzero(flag).tolist():
                    least = m.cut[c] + math.log(m.k[c] * max(1, n[i]))
                    count[i] = sum(m.lam[c] * s >= least for _, _, s in all_segments(p[o[i] : o[i + 1]].tolist()))
                out += [pa.array(np.where(n > 0, np.maximum(0.0, e), 0.0)), pa.array(flag), pa.array(count)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], *out], [*cols, *[f"{c}{s}" for c in CATEGORIES for s in ("", "_flag", "_passages")]])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return docs.select(*cols, text).mapInArrow(run, f"{kept}, {fields}")


def found(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, category): a row for each category that applies."""
    s = scores(docs, labels, key, text)
    return s.select(key, F.explode(F.array_compact(F.array(*[F.when(F.col(f"{c}_flag"), F.lit(c)) for c in CATEGORIES]))).alias("category"))


def rates(docs: DataFrame, labels: DataFrame, source: str = "source") -> DataFrame:
    """(source, n_docs, and for each category the number and rate of flagged documents)."""
    s = scores(docs, labels, keep=(source,))
    out = [F.count("*").alias("n_docs")]
    for c in CATEGORIES:
        out += [F.count_if(f"{c}_flag").alias(f"n_{c}"), F.avg(F.col(f"{c}_flag").cast("int")).alias(f"rate_{c}")]
    return s.groupBy(source).agg(*out)

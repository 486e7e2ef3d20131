"""Same or near-same records across splits: weighted cosine join.

Method: each text is the vector of its word shingles, a shingle's squared weight growing with its rarity from 1 to RATIO.
Two sets of Jaccard similarity t share at least t of their union, so their cosine is at least
1 / (1 + RATIO * (1 - t) / (2 * t)), whatever the weights of what they share: that floor is proved, not measured. Inverted
lists of each block of vectors hold the features a vector needs, in the order of falling weight: those before the rest can no
longer reach the floor, by the rest's norm or by the greatest weight that any vector of fitting size can have on it
(maximum-weight pruning). Train and evaluation vectors that meet in lists add up the products of their weights; a pair whose
sum and the product of its residual norms stay below the floor is pruned, as is one whose bitmaps are too far apart. What is
left gets the exact Jaccard similarity of the whole sets. No pair at or above the threshold is left out.

Scale: sets are computed once. Equal texts are one vector. Blocks of evaluation vectors are the query set that all train
vectors meet, so the work grows with the product of the two. Equal hashes and classes of equal texts are counted on both
sides before anything is paired; the report pairs classes only. What is collected are the features in more than a fixed
share of texts, at most the mean text's features divided by that share.

Defined results: NULL splits and hashes match nothing; case and outer blanks of splits and the case of hashes don't count.
Rows repeated in full count once. Blank and NULL texts match nothing. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .jaccard import block_pairs, exact, meet, packed_blocks, sides, sums
from .shingles import feature_sets, frequent_features

JACCARD = 0.55
SHARE = 5e-4  # features in a smaller share of the texts have the greatest weight
RATIO = 1.25  # of the greatest squared weight to the least; a greater one lowers the floor more than it parts the texts
CUT = 0.01  # from this share of the texts on, features are left to the residual norms where those allow it
TRAIN, EVAL = 1, 2


def floor(jaccard: float = JACCARD) -> float:
    """The least cosine of two sets of that Jaccard similarity under weights() of any features."""
    return 1 / (1 + RATIO * (1 - jaccard) / (2 * jaccard))


def weights(v: np.ndarray, known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The squared weight of each feature."""
    if not len(known):
        return np.full(len(v), RATIO)
    at = np.searchsorted(known, v)
    at[at == len(known)] = 0
    rarity = np.log(1 / np.clip(share, SHARE, 1.0)) / np.log(1 / SHARE)
    return np.where(known[at] == v, (1 + (RATIO - 1) * rarity)[at], RATIO)


def prefixes(v: np.ndarray, o: np.ndarray, w: np.ndarray, jaccard: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, index of its vector, number of each vector's, norm of each vector, residual norm behind the lists, residual norm behind CUT).

    One order of features for all vectors: falling weight, then the feature. Norms are of unit vectors but for the third last.
    """
    n = np.diff(o)
    doc = np.repeat(np.arange(len(n)), n)
    norm2 = np.bincount(doc, w, minlength=len(n))
    order = np.lexsort((v, -w, doc))
    v, w = v[order], w[order]
    c = np.cumsum(w)
    rest = norm2[doc] - (c - w - np.r_[0.0, c][o[:-1]][doc])  # squared, of this place and all behind it
    reach = np.minimum(np.sqrt(rest / norm2[doc]), rest / np.sqrt(norm2[doc] * jaccard * n[doc]))
    cut = 1 + (RATIO - 1) * np.log(1 / CUT) / np.log(1 / SHARE)
    keep = (w > cut) | (reach >= floor(jaccard) - 1e-9)
    p = np.bincount(doc[keep], minlength=len(n))
    behind = norm2 - np.bincount(doc[keep], w[keep], minlength=len(n))
    common = norm2 - np.bincount(doc[w > cut], w[w > cut], minlength=len(n))
    unit = np.sqrt(np.maximum(norm2, 1e-300))
    return v[keep], doc[keep], p, unit, np.sqrt(np.maximum(behind, 0)) / unit, np.sqrt(np.maximum(common, 0)) / unit


def candidates(sets: DataFrame, known: np.ndarray, share: np.ndarray, jaccard: float = JACCARD) -> DataFrame:
    """(a, b): pairs of set ids, among which are all of a train and an evaluation set that reach the similarity. sets: (fp, s, side)."""
    table = sets.sparkSession.sparkContext.broadcast((known, share))
    least = floor(jaccard)

    def prefix(v, o):
        f, d, p, unit, rest, common = prefixes(v, o, weights(v, *table.value), jaccard)
        # the three numbers of a set as one: norms below one beside a norm of whole sets
        return f, d, p, np.stack([unit, rest, common], axis=1).astype(np.float64).view(np.dtype((np.void, 24))).ravel()

    def meeting(x, y):
        """Of the pairs that share enough features for their sizes, those whose products and residual norms reach the floor."""
        i, j = meet(x[0], y[0], jaccard)
        if not len(i):
            return i, j
        (of, nx, fx, dx, ux, rx, gx), (on, ny, fy, dy, uy, ry, gy) = within(x, np.unique(i)), within(y, np.unique(j))
        a, b = [i[:0]], [j[:0]]
        i, j = np.searchsorted(of, i), np.searchsorted(on, j)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for first, last, total in sums(nx, len(ny), (fx, dx), (fy, dy), weights(fx, *table.value) / ux[dx]):
            part = slice(*np.searchsorted(i, [first, last]))
            p, q = i[part], j[part]
            # behind the shorter lists of the two lies at most the one's residual norm times the other's behind CUT
            good = total[p - first, q] / uy[q] >= least - np.maximum(rx[p] * gy[q], gx[p] * ry[q]) - 1e-6
            a.append(of[p[good]])
            b.append(on[q[good]])
        return np.concatenate(a), np.concatenate(b)

    left, right = sides(packed_blocks(sets, prefix, (TRAIN, EVAL)))
    two = left.where(F.col("kind") == TRAIN).hint("shuffle_replicate_nl").crossJoin(right.where(F.col("okind") == EVAL))
    return block_pairs(two, meeting)


def within(block: tuple, some: np.ndarray) -> tuple:
    """(some; of these vectors of a block: sizes; features, sorted; the vector of each, as a place in some; norms, residual norms, those behind CUT)."""
    (n, features, _, number, d, *_), _, r = block
    at = np.full(len(n), -1, np.int32)
    at[some] = np.arange(len(some))
    keep = np.flatnonzero(at[d] >= 0)
    keep = keep[np.argsort(number[keep], kind="stable")]
    return some, n[some], features[number[keep]], at[d[keep]], *r.reshape(-1, 3)[some].T


def _clean(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def entries(manifest: DataFrame) -> DataFrame:
    """(id, split, sha, source_type, side, stem) of the entries in train, val or test, each once."""
    split = _clean(F.col("split"))
    side = F.when(split == "train", TRAIN).when(split.isin("val", "test"), EVAL)
    stem = F.regexp_extract("id", r"^(bench_\d+)$", 1)
    m = manifest.select("id", split.alias("split"), F.lower("input_sha256").alias("sha"), "source_type", side.cast("int").alias("side"), F.nullif(stem, F.lit("")).alias("stem"))
    return m.where("id IS NOT NULL AND side IS NOT NULL").distinct()


def text_classes(e: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(entries with a labelled text: id, side, fp) and (links: a, b of the classes of a train and an evaluation text, both ways round)."""
    stem = F.regexp_extract("filename", r"^(.*)\.[^.]*$", 1)
    rows = labels.select(F.col(key).alias("row"), stem.alias("stem"), F.col(text).alias("text"))
    table = feature_sets(rows, "row", "text", SHARE)
    fps = table.where("fp <> 0").select(F.col("id").alias("row"), "fp")
    n = fps.count()
    known, counts = frequent_features(table, SHARE, n)
    stems = labels.select(F.col(key).alias("row"), stem.alias("stem")).join(fps, "row").select("stem", "fp")
    member = written(e.where("stem IS NOT NULL").select("id", "side", "stem").join(stems, "stem").select("id", "side", "fp"), "members")
    side = member.groupBy("fp").agg(F.bit_or("side").alias("side"))
    sets = table.where("s IS NOT NULL").select("fp", "s")
    sided = sets.join(side, "fp").select("fp", "s", "side")
    pairs = written(exact(sets, written(candidates(sided, known, counts / max(1, n)), "candidates"), JACCARD).select("a", "b"), "cross")
    both = side.where("side = 3").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    return member, pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(both)


def overlaps(manifest: DataFrame, labels: DataFrame, key: str = "label_id", text: str = "full_text") -> DataFrame:
    """(train, other, why): pairs of entry ids in train and in val or test with equal input or the same labelled text."""
    e = written(entries(manifest), "entries")
    t, v = e.where(F.col("side") == TRAIN), e.where(F.col("side") == EVAL)
    by_hash = t.where("sha IS NOT NULL").select("sha", F.col("id").alias("train")).join(v.select("sha", F.col("id").alias("other")), "sha").select("train", "other", F.lit("input").alias("why"))
    member, links = text_classes(e, labels, key, text)
    left = member.where(F.col("side") == TRAIN).select(F.col("fp").alias("a"), F.col("id").alias("train"))
    right = member.where(F.col("side") == EVAL).select(F.col("fp").alias("b"), F.col("id").alias("other"))
    by_text = links.join(left, "a").join(right, "b").where("train <> other").select("train", "other", F.lit("text").alias("why"))
    return by_hash.where("train <> other").unionByName(by_text).distinct()


def found(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """(id_a, id_b): every overlapping pair of ids once, smaller first."""
    o = overlaps(manifest, labels)
    return o.select(F.least("train", "other").alias("id_a"), F.greatest("train", "other").alias("id_b")).distinct()


def _others(have: DataFrame, key: str, train: DataFrame) -> DataFrame:
    """The ids of have (key, id) that stand under a key with a train entry of another id. train: (key, id)."""
    first = train.groupBy(key).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    return have.join(first, key).where("id <> least OR id <> most").select("id").distinct()


def report(manifest: DataFrame, labels: DataFrame, key: str = "label_id", text: str = "full_text") -> DataFrame:
    """(split, source_type, n_entries, n_overlapping, n_input, n_text) of the val and test entries; entries are never paired, only their classes."""
    e = written(entries(manifest), "entries")
    t, v = e.where(F.col("side") == TRAIN), e.where(F.col("side") == EVAL)
    by_input = _others(v.where("sha IS NOT NULL").select("sha", "id"), "sha", t.where("sha IS NOT NULL").select("sha", "id")).withColumn("i", F.lit(1))
    member, links = text_classes(e, labels, key, text)
    train = member.where(F.col("side") == TRAIN).select(F.col("fp").alias("a"), "id")
    ends = train.groupBy("a").agg(F.min("id").alias("least"), F.max("id").alias("most"))  # of each class, enough to tell whether it holds another id
    near = links.join(ends, "a").groupBy("b").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    by_text = member.where(F.col("side") == EVAL).select("id", F.col("fp").alias("b")).join(near, "b").where("id <> least OR id <> most").select("id").distinct().withColumn("t", F.lit(1))
    j = v.select("id", "split", "source_type").distinct().join(by_input, "id", "left").join(by_text, "id", "left")
    return j.groupBy("split", "source_type").agg(
        F.count("*").alias("n_entries"), F.count(F.coalesce("i", "t")).alias("n_overlapping"), F.coalesce(F.sum("i"), F.lit(0)).cast("long").alias("n_input"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("n_text")
    )

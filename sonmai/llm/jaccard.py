"""All pairs of texts whose shingle sets reach a Jaccard similarity: an exact join by prefixes, shared by the similarity joins.

Method: features are put into one order, the rare ones first. Two sets of n and m features and Jaccard similarity t have at
least t / (1 + t) * (n + m) in common, and never fewer than t * n; so they share a feature among the first
n - ceil(t * n) + 1 of each, and as many there as that overlap leaves when the longer rest is taken off. Pairs that share so
many are the candidates, but those whose bitmaps of all features differ in more bits than the sets may differ in features;
whoever calls verifies them by the whole sets. No pair at or above the threshold is left out, however frequent its features
are.

Scale: sets are read from the one table of features; prefixes travel in packed blocks of bounded size, written once. Every
block meets every other, as a query set meets all rows, and counts within the task, so nothing is shuffled by feature or by
pair but the candidates. Within two blocks, classes of like sizes meet where those sizes allow the similarity, and by no more
of the prefixes than they ask for. The work of meeting is quadratic in the distinct texts.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import in_sorted

TEXTS, ENTRIES = 8192, 2_000_000  # of a block, at most; one longer text is a block of its own
CELLS, MEETINGS = 250_000, 2_000_000  # counted at once, so that they stay in cache
BITS = 2048  # of the bitmap of a set
RATIO, FEW = 1.25, 256  # of the greatest size to the least in a class of like sizes, but that it has so many sets
AGAIN = 4  # features that two prefixes must share at least; of large sets a 64th, as bitmaps tell those apart less well
COLUMNS = ("fp", "n", "r", "f", "d", "q", "bits")
_TYPES = (np.int64, np.int32, np.float64, np.int32, np.uint16, np.uint16, np.uint64)
_BLOCK = "block long, kind int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def prefix_lengths(n: np.ndarray, t: float) -> np.ndarray:
    return np.where(n > 0, n - np.ceil(t * n - 1e-9).astype(np.int64) + 1, 0)


def prefixes(v: np.ndarray, o: np.ndarray, known: np.ndarray, counts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(feature, index of its set) of the sets' prefixes. The order: features that aren't known, then the known by count; equal ones by hash."""
    n = np.diff(o)
    doc = np.repeat(np.arange(len(n)), n)
    c = np.zeros(len(v), np.int64)
    if len(known) and len(v):
        at = np.searchsorted(known, v)
        at[at == len(known)] = 0
        c = np.where(known[at] == v, counts[at], 0)
    order = np.argsort((doc << 32) + c, kind="stable")  # in a set, features are sorted
    keep = np.arange(len(v)) - o[:-1][doc] < prefix_lengths(n, t)[doc]
    return v[order][keep], doc[keep]


def bitmaps(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each set, the bits its features fall on, as rows of 64-bit words."""
    got = np.zeros((len(n), BITS), bool)
    got[np.repeat(np.arange(len(n)), n), v.view(np.uint32) % np.uint32(BITS)] = True
    return np.packbits(got, axis=1).view(np.uint64)


def alike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the bitmaps x[i] and y[j] differ in no more bits than most: each such bit takes a feature that only one set has."""
    good = np.empty(len(i), bool)
    for at in range(0, len(i), 50_000):
        part = slice(at, at + 50_000)
        good[part] = np.bitwise_count(x[i[part]] ^ y[j[part]]).sum(axis=1, dtype=np.int64) <= most[part]
    return good


def sums(nx: np.ndarray, width: int, x: tuple, y: tuple, value=None):
    """(first, last, totals): for rows of sets of one block at a time, what each set of theirs adds up to with every set of the other.

    x, y: (features, sorted; the set of each). value: weight of a place in y's features with one in x's, 1 without it.
    """
    (fx, dx), (fy, dy) = x, y
    lo, hi = np.searchsorted(fy, fx, "left"), np.searchsorted(fy, fx, "right")
    order = np.argsort(dx, kind="stable")
    order = order[hi[order] > lo[order]]
    lo, size, doc = lo[order], (hi - lo)[order], dx[order].astype(np.int64)
    step = max(1, CELLS // width)
    for first in range(0, len(nx), step):
        last = min(first + step, len(nx))
        begin, end = np.searchsorted(doc, [first, last])
        if begin == end:
            continue
        total = np.zeros((last - first) * width, np.int64 if value is None else np.float64)
        ends = np.cumsum(size[begin:end])
        at = 0
        while at < end - begin:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + MEETINGS, "right")))
            s = size[begin + at : begin + to]
            begun = np.cumsum(s) - s
            place = np.repeat(lo[begin + at : begin + to] - begun, s) + np.arange(int(s.sum()))
            key = np.repeat((doc[begin + at : begin + to] - first) * width, s) + dy[place]
            w = None if value is None else np.repeat(value[order[begin + at : begin + to]], s)
            total += np.bincount(key, w, minlength=len(total))
            at = to
        yield first, last, total.reshape(-1, width)


def opened(n, f, d, q, bits) -> tuple:
    """A block for meet(): (sizes, rising; features without repeats, sorted; first set of each class of like sizes and the end;
    by class and then by feature, of each place of a prefix: the feature's number, the set, the place; the ends of the classes there; bitmaps)."""
    n, edges = n.astype(np.int64), [0]
    while edges[-1] < len(n):
        a = edges[-1]
        edges.append(min(len(n), max(a + FEW, int(np.searchsorted(n, n[a] * RATIO, "right")))))
    edges = np.array(edges)
    first = np.r_[True, f[1:] != f[:-1]] if len(f) else np.empty(0, bool)
    number = np.cumsum(first, dtype=np.int32) - np.int32(1)
    like = np.repeat(np.arange(len(edges) - 1, dtype=np.uint16), np.diff(edges))[d]
    order = np.argsort(like, kind="stable")
    ends = np.searchsorted(like[order], np.arange(len(edges)))
    return n, f[first], edges, number[order], d[order].astype(np.int32), q[order], ends, bits.reshape(len(n), -1)


def needed(n: np.ndarray, p: np.ndarray, others: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(features any set of the other block's sizes must share with each, places of each prefix that are enough for some of them)."""
    overlap = np.ceil(t / (1 + t) * (n + np.maximum(others[0], t * n)) - 1e-6).astype(np.int64)
    return overlap, np.minimum(n - overlap + np.maximum(AGAIN, n // 64), p)


def met(total_x: int, width: int, number: int, x: tuple, y: tuple, least: int):
    """(keys, counts): key = set of x * width + set of y, for the pairs that have at least so many features in common. x, y: (number of each feature, rising; its set)."""
    (fx, dx), (fy, dy) = x, y
    count = np.bincount(fy, minlength=number)
    size = count[fx]
    use = np.flatnonzero(size)
    use = use[np.argsort(dx[use], kind="stable")]
    size, dx, begun = size[use], dx[use], (np.cumsum(count) - count)[fx[use]]
    ends = np.cumsum(size)
    edges = np.searchsorted(dx, np.arange(total_x + 1))
    first = 0
    while first < total_x:
        before = ends[edges[first] - 1] if edges[first] else 0
        last = max(first + 1, int(np.searchsorted(np.r_[0, ends][edges], before + MEETINGS, "right")) - 1)
        part = slice(edges[first], edges[last])
        first = last
        if part.start == part.stop:
            continue
        n = size[part]
        place = np.repeat((begun[part] - (ends[part] - before - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        key = np.repeat(dx[part].astype(np.int32) * np.int32(width), n)
        key += dy[place]
        key.sort()
        got = key[: max(0, len(key) - least + 1)]
        got = got[got == key[least - 1 :]]
        if len(got):
            new = np.flatnonzero(np.r_[True, got[1:] != got[:-1]])
            yield got[new], np.diff(np.r_[new, len(got)]) + least - 1


def meet(x: tuple, y: tuple, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of the sets of two opened() blocks that share enough of their prefixes and whose bitmaps allow the similarity t."""
    (nx, ux, ex, fx, dx, qx, sx, bx), (ny, uy, ey, fy, dy, qy, sy, by) = x, y
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if not len(fx) or not len(fy):
        return a[0], b[0]
    at = np.searchsorted(uy, ux)
    at[at == len(uy)] = 0
    both = np.flatnonzero(uy[at] == ux)
    numx, numy = np.full(len(ux), -1, np.int32), np.full(len(uy), -1, np.int32)
    numx[both] = numy[at[both]] = np.arange(len(both), dtype=np.int32)
    classes = []
    for n, e, f, d, q, s in ((nx, ex, numx[fx], dx, qx, sx), (ny, ey, numy[fy], dy, qy, sy)):
        full = np.bincount(d, minlength=len(n))
        use = np.flatnonzero(f >= 0)
        f, d, q, s = f[use], d[use], q[use], np.searchsorted(use, s)
        classes.append([(e[k], n[e[k] : e[k + 1]], full[e[k] : e[k + 1]], f[s[k] : s[k + 1]], d[s[k] : s[k + 1]] - np.int32(e[k]), q[s[k] : s[k + 1]]) for k in range(len(e) - 1)])
    for xa, mx, px, fx, dx, qx in classes[0]:
        for ya, my, py, fy, dy, qy in classes[1]:
            if my[-1] < t * mx[0] - 1e-6 or mx[-1] < t * my[0] - 1e-6:
                continue
            (ox, cx), (oy, cy) = needed(mx, px, my, t), needed(my, py, mx, t)
            if (cx <= mx - ox).any() or (cy <= my - oy).any():  # a list that was cut shorter for other reasons: all of both, where one is enough
                cx, cy, least = px, py, 1
            else:
                least = max(1, int(min((ox - mx + cx).min(), (oy - my + cy).min())))
            kx, ky = np.flatnonzero(qx < cx.astype(np.int32)[dx]), np.flatnonzero(qy < cy.astype(np.int32)[dy])
            for key, c in met(len(mx), len(my), len(both), (fx[kx], dx[kx]), (fy[ky], dy[ky]), least):
                i, j = np.divmod(key, np.int32(len(my)))
                need = np.ceil(t / (1 + t) * (mx[i] + my[j]) - 1e-6) - np.maximum((mx - cx)[i], (my - cy)[j])
                good = (c >= need) & (np.minimum(mx[i], my[j]) >= t * np.maximum(mx[i], my[j]) - 1e-6)
                i, j = i[good].astype(np.int64) + xa, j[good].astype(np.int64) + ya
                good = close(bx, by, nx, ny, i, j, t)
                a.append(i[good])
                b.append(j[good])
    return np.concatenate(a), np.concatenate(b)


def close(bx, by, nx, ny, i, j, t: float) -> np.ndarray:
    """Whether bitmaps and sizes allow the Jaccard similarity t."""
    return alike(bx, by, i, j, nx[i] + ny[j] - 2 * np.ceil(t / (1 + t) * (nx[i] + ny[j]) - 1e-6).astype(np.int64))


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of a batch of packed sets end to end, and their offsets. Sorted within each set."""
    got = [np.frombuffer(x.as_buffer(), np.int32) if x.is_valid else np.empty(0, np.int32) for x in column]
    return (np.concatenate(got) if got else np.empty(0, np.int32)), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)


def packed_blocks(sets: DataFrame, prefix, kinds: tuple[int, ...] = (0,)) -> DataFrame:
    """Blocks of sets with their prefixes, written. sets: (fp, s) or (fp, s, side); a set goes to the blocks of each kind whose bits its side has.

    prefix(v, offsets) gives (features, set of each, length of each set's, an array of one item or several 64-bit numbers of each set for the join's own use).
    """

    def pack(batches):
        made = TaskContext.get().partitionId() << 32
        held = {kind: [] for kind in kinds}

        def out(kind):
            nonlocal made
            parts, held[kind] = held[kind], []
            fp, n, r, f, d, q, bits = (np.concatenate(z) for z in zip(*parts))
            d = d + np.repeat(np.cumsum([0, *(len(z[0]) for z in parts[:-1])]), [len(z[4]) for z in parts])
            by_size = np.argsort(n, kind="stable")
            place = np.empty(len(n), np.int64)
            place[by_size] = np.arange(len(n))
            order = np.argsort(f, kind="stable")
            made += 1
            row = [made, kind, *(z.tobytes() for z in (fp[by_size], n[by_size].astype(np.int32), r[by_size], f[order], place[d][order].astype(np.uint16), q[order], bits[by_size]))]
            kept = [pa.int64(), pa.int32(), *[pa.binary()] * len(COLUMNS)]
            return pa.RecordBatch.from_arrays([pa.array([z], kt) for z, kt in zip(row, kept)], ["block", "kind", *COLUMNS])

        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                fp = batch.column(0).to_numpy(zero_copy_only=False)
                v, o = unpacked(batch.column(1))
                side = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if len(kinds) > 1 else np.zeros(len(fp), np.int64)
                new = np.array([x not in seen and not seen.add(x) for x in fp.tolist()], bool)
                if len(seen) > 5_000_000:
                    seen.clear()
                for kind in kinds:
                    use = new & ((side & kind) == kind)
                    m = np.diff(o)[use]
                    u = v[np.repeat(use, np.diff(o))]
                    f, d, p, r = prefix(u, np.r_[0, np.cumsum(m)])
                    bits, ids = bitmaps(u, m), fp[use]
                    ends, k = np.cumsum(p), 0
                    q = np.minimum(np.arange(len(f)) - (ends - p)[d], 65535).astype(np.uint16)
                    while k < len(m):
                        room = ENTRIES - sum(len(z[3]) for z in held[kind])
                        fits = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + room, "right"))
                        to = min(fits, k + TEXTS - sum(len(z[0]) for z in held[kind]))
                        if to <= k and held[kind]:
                            yield out(kind)
                            continue
                        to = max(to, k + 1)
                        x, y = ends[k - 1] if k else 0, ends[to - 1]
                        held[kind].append((ids[k:to], m[k:to], r[k:to], f[x:y], d[x:y] - k, q[x:y], bits[k:to]))
                        k = to
        for kind in kinds:
            if held[kind]:
                yield out(kind)

    return written(sets.mapInArrow(pack, _BLOCK), "blocks")


def block_pairs(two: DataFrame, meeting) -> DataFrame:
    """(a, b), a < b: meeting(x, y) of each row's two blocks, distinct. x, y: an opened() block, its set ids, what prefix() gave of each set."""

    def compare(batches):
        kept: OrderedDict = OrderedDict()

        def block(batch, at, row):
            name = batch.column(at)[row].as_py()
            if name not in kept:
                if len(kept) > 3:
                    kept.popitem(last=False)
                fp, n, r, f, d, q, bits = (np.frombuffer(batch.column(at + 1 + k)[row].as_buffer(), t) for k, t in enumerate(_TYPES))
                kept[name] = opened(n, f, d, q, bits), fp, r
            kept.move_to_end(name)
            return kept[name]

        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (block(batch, at, row) for at in (0, len(COLUMNS) + 1))
                i, j = meeting(x, y)
                a, b = x[1][i], y[1][j]
                two = a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[two]), pa.array(np.maximum(a, b)[two])], ["a", "b"])

    return two.select("block", *(f"x{c}" for c in COLUMNS), "other", *(f"y{c}" for c in COLUMNS)).mapInArrow(compare, "a long, b long").distinct()


def sides(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        blocks.select("block", "kind", *(F.col(c).alias(f"x{c}") for c in COLUMNS)),
        blocks.select(F.col("block").alias("other"), F.col("kind").alias("okind"), *(F.col(c).alias(f"y{c}") for c in COLUMNS)),
    )


def candidates(sets: DataFrame, known: np.ndarray, counts: np.ndarray, threshold: float) -> DataFrame:
    """(a, b): pairs of set ids, a < b, among which are all whose similarity reaches the threshold. sets: (fp, s)."""
    table = sets.sparkSession.sparkContext.broadcast((known, counts))

    def prefix(v, o):
        f, d = prefixes(v, o, *table.value, threshold)
        return f, d, prefix_lengths(np.diff(o), threshold), np.zeros(len(o) - 1)

    left, right = sides(packed_blocks(sets, prefix))
    two = left.hint("shuffle_replicate_nl").join(right, F.col("block") <= F.col("other"))
    return block_pairs(two, lambda x, y: meet(x[0], y[0], threshold))


def exact(sets: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the candidate pairs whose exact similarity reaches the threshold. sets: (fp, s), repeats allowed."""
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = written(sets.select("fp", "s").join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "sets")

    def compare(batches):
        for batch in batches:
            jac = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(y.as_buffer(), np.int32)
                both = int(in_sorted(x, y).sum())
                jac.append(both / (len(x) + len(y) - both) if len(x) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(jac, pa.float64())], ["a", "b", "jaccard"])

    two = candidates.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, jaccard double").where(F.col("jaccard") >= threshold)

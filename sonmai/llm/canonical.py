"""Mapping free-entered values to a canonical list: a broadcast symmetric-delete dictionary.

Method: the entries of the reference list, with the abbreviated and reordered forms that follow from them, are indexed by
their deletion neighbourhoods; a value looks up its own deletions, candidates are ranked by weighted Damerau–Levenshtein
distance, then by how often the entry itself occurs in all rows, spelled exactly, then by the value's plain distance to
its name. Values without a candidate in the bound are reported as misses.

Scale: distinct values are mapped, each once. The dictionary is built once on the driver and broadcast, in parts of at most
PART entries and PART_BYTES; a longer list is more parts, each value takes the best entry of all, so no length is too great.
A value that a great part of the rows hold meets its entry in a join whose skewed partitions Spark splits.

Defined results: NULL and blank values are left out; an empty list makes every value a miss. A value that is exactly an
entry maps to it with distance 0. Entries with NULL names are ignored; of equal names the smaller id counts.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .confusables import consistent
from .names import Index, compact, distance, fold, short_forms

PART, PART_BYTES = 4_000, 64 << 20  # of the list in one broadcast dictionary, at most
# Words people put around the name of a kind of document.
AROUND = ("van ban", "so", "loai", "mau")


def _tidy(s: str) -> str:
    return re.sub(r"\s+", " ", consistent(s)).strip(" .:;,()[]\"'“”-").lower()


def split_kind(names: dict[int, list[str]], shorts: dict[int, str | None]) -> dict[int, int]:
    """How many of a name's words say the kind of body: what remains ends its short name, or else follows a common beginning."""
    at: dict[int, int] = {}
    ends = defaultdict(set)
    for w in names.values():
        for i in range(1, len(w)):
            ends[tuple(w[:i])].add(w[i])
    for k, w in names.items():
        s = fold(shorts.get(k) or "")
        n = next((i for i in range(1, len(w)) if s[1:] == w[i:]), 0) if len(s) > 1 else 0
        at[k] = n or max((i for i in range(1, len(w)) if len(ends[tuple(w[:i])]) >= 3), default=0)
    return at


class Types:
    """Kinds of documents: names, codes, first word cut to its initial, words around them."""

    def __init__(self, refs: list[tuple[int, str, str | None]], uses: dict[int, int] | None = None):
        self.uses = uses or {}
        self.exact = {}
        self.codes: dict[str, int] = {}
        self.folded_codes: dict[str, set[int]] = defaultdict(set)
        self.index, self.index2, self.cut, self.near_cut = Index(1), Index(2), defaultdict(set), Index(1)
        self.names = {i: n for i, n, _ in refs}
        for i, name, code in sorted(refs, reverse=True):
            self.exact[_tidy(name)] = i
            w = fold(name)
            c = compact(w)
            self.index.add(c, i)
            if len(c) >= 9:
                self.index2.add(c, i)
            if code:
                self.codes[_tidy(code)] = i
                self.folded_codes["".join(fold(code))].add(i)
            if len(w) > 1:
                form = w[0][0] + " " + " ".join(w[1:])
                self.cut[form].add(i)
                self.near_cut.add(form, i)

    def find(self, value: str) -> tuple[int, float]:
        t = _tidy(value)
        for _ in range(2):
            if t in self.exact:
                return self.exact[t], 0.05
            if t in self.codes:
                return self.codes[t], 0.1
            w = fold(t)
            c = compact(w)
            if not c or not re.search(r"[^\W\d_]", t):
                return 0, 9.0
            if len(self.folded_codes.get(c, ())) == 1 and len(c) <= 4 and len(w) == 1:
                return next(iter(self.folded_codes[c])), 0.2
            if len(self.cut.get(" ".join(w), ())) == 1:
                return next(iter(self.cut[" ".join(w)])), 0.15
            got = self.index.find(c) if len(c) >= 4 else [x for x in self.index.find(c) if x[0] == 0]
            if len(w) > 1 and len(w[0]) == 1 and not got:  # an initial, and a slip in the rest
                got = [(d + 0.5, k, i) for d, k, i in self.near_cut.find(" ".join(w)) if len(self.cut[k]) == 1]
            if not got and len(c) >= 8:
                got = self.index2.find(c)
            if got:
                best = [i for d, _, i in got if d <= got[0][0] + 0.01]
                best.sort(key=lambda i: (-self.uses.get(i, 0), distance(t, self.names[i].lower(), 9), i))
                return best[0], got[0][0]
            short = t
            for a in AROUND:
                fw = fold(short)
                aw = a.split()
                if len(fw) > len(aw) and fw[: len(aw)] == aw:
                    short = " ".join(short.split()[len(aw) :])
                fw = fold(short)
                if len(fw) > len(aw) and fw[-len(aw) :] == aw:
                    short = " ".join(short.split()[: -len(aw)])
            short = _tidy(short)
            if short == t:
                break
            t = short
        return 0, 9.0


class Agencies:
    """Bodies with a kind and a place: either may come first, the kind may be abbreviated, one may hold a slip."""

    def __init__(self, refs: list[tuple[int, str, str | None]], uses: dict[int, int] | None = None):
        self.uses = uses or {}
        self.names = {i: n for i, n, _ in refs if n}
        words = {i: fold(n) for i, n in self.names.items()}
        at = split_kind(words, {i: s for i, _, s in refs})
        self.whole = Index(2)
        self.kinds, self.places = Index(1), Index(1)
        self.of: dict[tuple[str, str], int] = {}
        kinds: dict[tuple[str, ...], str] = {}
        weight = Counter()
        for i in sorted(self.names, reverse=True):
            w, k = words[i], at[i]
            self.whole.add(compact(w), i)
            if k:
                kind, place = compact(w[:k]), compact(w[k:])
                kinds[tuple(w[:k])] = kind
                self.of[kind, place] = i
                weight[place] += 1
                self.whole.add(place + kind, i, 0.05)
        for i, _, s in refs:
            if s and i in self.names:
                self.whole.add(compact(fold(s)), i, 0.1, most=1)
        forms: dict[str, dict[str, float]] = defaultdict(dict)
        for w, kind in kinds.items():
            for f, x in short_forms(list(w)).items():
                forms[f][kind] = min(x, forms[f].get(kind, 9.0))
        for f, owners in forms.items():
            low = min(owners.values())
            best = [k for k, x in owners.items() if x <= low + 0.04]
            for k in best:  # forms of several kinds stay candidates of each; the place may tell
                self.kinds.add(f, k, owners[k], most=1 if len(f) > 4 else 0)
        for p in weight:
            self.places.add(p, p, most=1 if len(p) > 4 else 0)

    def find(self, value: str) -> tuple[int, float]:
        w = fold(value)
        c = compact(w)
        if not c:
            return 0, 9.0
        best: dict[int, float] = {}
        for d, _, i in self.whole.find(c, 1 if len(c) < 10 else 2):
            best[i] = min(d, best.get(i, 9.0))
        if not best or min(best.values()) > 0.5:
            for n in range(1, len(w)):
                for kind, place in ((w[:n], w[n:]), (w[n:], w[:n])):
                    places = self.places.find(compact(place))
                    if not places:
                        continue
                    for dk, _, k in self.kinds.find(compact(kind)):
                        for dp, _, p in places:
                            i = self.of.get((k, p))
                            if i is not None and dk + dp < 1.9:
                                best[i] = min(dk + dp, best.get(i, 9.0))
        if not best:
            return 0, 9.0
        low = min(best.values())
        t = _tidy(value)
        return min((i for i, d in best.items() if d <= low + 0.01), key=lambda i: (-self.uses.get(i, 0), distance(t, self.names[i].lower(), 30), i)), low


def entry_uses(values: DataFrame, reference: list[tuple[int, str, str | None]]) -> dict[int, int]:
    """How many rows of values have an entry's name exactly, by its id; at most one number per entry."""
    ids = {n: int(i) for i, n, _ in sorted((r for r in reference if r[0] is not None and r[1]), reverse=True, key=lambda r: r[0])}
    if not ids:
        return {}
    names = values.sparkSession.createDataFrame([(n,) for n in ids], "value string")
    return {ids[r.value]: r.n for r in values.join(names, "value").groupBy("value").agg(F.count("*").alias("n")).collect()}


def dictionaries(reference: list[tuple[int, str, str | None]], kind: str, uses: dict[int, int] | None) -> list[bytes]:
    """The list as dictionaries of bounded size, packed: its exact names, and the finder of the others."""
    refs = [(int(i), n, s) for i, n, s in reference if i is not None and n]

    def packed(part):
        exact = {n: i for i, n, _ in sorted(part, reverse=True)}
        blob = pickle.dumps((exact, (Types if kind == "type" else Agencies)(part, {i: (uses or {}).get(i, 0) for i, _, _ in part})))
        return [blob] if len(blob) <= PART_BYTES or len(part) < 2 else [x for half in (part[: len(part) // 2], part[len(part) // 2 :]) for x in packed(half)]

    return [x for at in range(0, max(1, len(refs)), PART) for x in packed(refs[at : at + PART])]


def map_values(values: DataFrame, reference: list[tuple[int, str, str | None]], kind: str, uses: dict[int, int] | None = None) -> DataFrame:
    """values: (value), distinct. uses: how often each entry occurs, which settles ties. Adds ref_id (0 for none), distance, and exact, whether the value is an entry's name."""
    uses = uses or {}
    parts = dictionaries(reference, kind, uses)
    out = None
    for blob in parts:
        shared = values.sparkSession.sparkContext.broadcast(blob)

        def run(batches, shared=shared):
            exact, m = pickle.loads(shared.value)
            for pdf in batches:
                got = [(exact[v], 0.0) if v in exact else m.find(v) for v in pdf["value"]]
                n = [m.uses.get(g[0], 0) for g in got]
                yield pd.DataFrame({"value": pdf["value"], "ref_id": pd.Series([g[0] for g in got], dtype="int64"), "distance": pd.Series([float(g[1]) for g in got], dtype="float64"), "exact": [v in exact for v in pdf["value"]], "n": pd.Series(n, dtype="int64")})

        one = values.select("value").mapInPandas(run, "value string, ref_id long, distance double, exact boolean, n long")
        out = one if out is None else out.unionByName(one)
    if len(parts) == 1:
        return out.drop("n")
    best = F.min_by(F.struct("ref_id", "distance", "exact"), F.struct(~F.col("exact"), "distance", -F.col("n"), "ref_id"))
    return out.groupBy("value").agg(best.alias("b")).select("value", "b.*")


def canonical_map(df: DataFrame, key: str, fields: dict[str, tuple[str, list, str]]) -> DataFrame:
    """(key, field, value, ref_id, distance, exact) of every non-blank value. fields: name -> (expression, reference rows, 'type' or 'agency')."""
    out = None
    for name, (expr, reference, kind) in fields.items():
        rows = df.select(key, F.expr(expr).alias("value")).where(F.length(F.regexp_replace("value", r"(?U)\s", "")) > 0)
        mapped = map_values(rows.select("value").distinct(), reference, kind, entry_uses(rows, reference))
        one = rows.join(mapped, "value").select(key, F.lit(name).alias("field"), "value", "ref_id", "distance", "exact")
        out = one if out is None else out.unionByName(one)
    return out


def reference_rows(ref: DataFrame, key: str, name: str, short: str) -> list[tuple[int, str, str | None]]:
    """The rows of a reference list, which the driver cuts into dictionaries."""
    return [tuple(r) for r in ref.select(key, name, short).collect()]


def misses(mapped: DataFrame) -> DataFrame:
    """(field, value, n) of the values that fit no entry."""
    return mapped.where("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("n"))

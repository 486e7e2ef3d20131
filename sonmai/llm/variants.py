"""Variant spellings of names typed by people: token deletion neighbourhoods and optimal alignment.

Method: the words names are made of (kinds of bodies, places, family and given names) are learned from the values
themselves and indexed by their symmetric-delete neighbourhoods; a value's tokens look up the words within one edit. Its
parts are then aligned at the lowest cost, in either order, where initials, abbreviations and runs of initials stand for
words and parts may be missing. A person's middle names are assigned optimally to those of the persons of that family and given name:
middle names that can't be assigned to one another are different persons'. Values with the same entity are linked.

Scale: all distinct values are counted for the words, which are summed before they are collected; what is collected and
broadcast has a share of the rows, so its number is bounded. Distinct values are aligned, each once, in a narrow map.
classes() gives each spelling its entity and its number of links; pairs are made within an entity only where they are wanted.

Defined results: NULL and blank values are left out. A value that can't be aligned is an entity with the values that fold
to the same words. Rows are counted before anything else, so repeated rows cost nothing. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import strip_marks, written
from .confusables import consistent
from .names import Index, compact, distance, fold, short_forms

#: Shares of the rows from which on a beginning may be a kind of body, a place of a kind counts, a word is a family or a given name.
KIND_SHARE, PLACE_SHARE, FAMILY_SHARE, GIVEN_SHARE = 3e-4, 1e-5, 1e-3, 5e-4
MID_SHARE = 0.02  # of the rows of a family and given name, for middle names to be those of a person
OTHER = 1.5  # the cost of a name assigned to another one
# Forms of address and degrees before a name.
TITLES = re.compile(r"^\s*(?:(?:PGS|GS|ThS|TS|BS|KS|LS|CN|Đ/c|Ông|Bà|Mr|Ms|Mrs)\b[.\s]*)+", re.IGNORECASE)
_ASIDE = re.compile(r"[“\"][^”\"]*[”\"]|\([^)]*\)")


def _strong(counts: dict[str, int], ratio: int) -> dict[str, int]:
    """Without the words that are within one edit of a word that many times more frequent."""
    index = Index(1)
    for w in counts:
        index.add(w, w)
    out = {}
    for w, n in counts.items():
        near = {k for d in _near(w) for k in index.near.get(d, ())}
        if not any(counts[k] >= ratio * n and k != w and distance(w, k, 1) <= 1 for k in near):
            out[w] = n
    return out


def _near(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


# --- bodies ----------------------------------------------------------------------------------------------------------


class Bodies:
    """Kinds and places learned from values; parse() gives the entity of a value."""

    def __init__(self, found: dict[tuple, int]):
        """found: beginnings that several words follow, with their rows."""
        found = {p: n for p, n in found.items() if not any(p[:i] in found for i in range(2, len(p)))}
        # kinds that are a slip or a short form of a greater one are that one
        order = sorted(found, key=lambda p: (-len(compact(list(p))), -found[p]))
        self.kind_of: dict[str, str] = {}
        forms: dict[str, dict[str, float]] = defaultdict(dict)
        heads: list[tuple] = []
        for p in order:
            c = compact(list(p))
            if c in forms or any(found[h] >= 3 * found[p] and distance(c, compact(list(h)), 1) <= 1 for h in order if h != p):
                continue
            heads.append(p)
            for f, x in short_forms(list(p)).items():
                forms[f][c] = min(x, forms[f].get(c, 9.0))
        self.kinds = Index(1)
        for f, owners in forms.items():
            for k, x in owners.items():
                self.kinds.add(f, k, x, most=1 if len(f) > 4 else 0)
        self.heads = set(heads)

    def learn_places(self, pairs: dict[tuple[str, str], int]) -> None:
        """pairs: (kind, place) with their rows."""
        self.pairs = Counter(pairs)
        places: Counter = Counter()
        for (_, p), n in sorted(pairs.items()):
            places[p] += n
        self.places = Index(1)
        for p in _strong(dict(places), 4):
            self.places.add(p, p, most=1 if len(p) > 4 else 0)

    def parse(self, value: str) -> str:
        w = fold(value)
        best: list[tuple[float, str, str]] = []
        for n in range(1, len(w)):
            for k, p in ((w[:n], w[n:]), (w[n:], w[:n])):
                kinds = self.kinds.find(compact(k))
                if not kinds:
                    continue
                places = self.places.find(compact(p))
                for dk, _, kind in kinds:
                    for dp, _, place in places:
                        known = self.pairs.get((kind, place), 0)
                        if dk + dp < 1.9:
                            best.append((dk + dp + (0 if known else 0.35), kind, place))
        if best:
            _, kind, place = min(best, key=lambda x: (x[0], -self.pairs.get(x[1:], 0), x[1:]))
            return kind + "|" + place
        c = compact(w)  # spaces left out or put in: the whole, with a slip at most
        for cut in range(len(c) - 3, 3, -1):
            for k, p in ((c[:cut], c[cut:]), (c[cut:], c[:cut])):
                if p in self.places.exact and (found := self.kinds.find(k)):
                    return found[0][2] + "|" + p
                if k in self.kinds.exact and (near := self.places.find(p)):
                    return self.kinds.find(k)[0][2] + "|" + near[0][2]
        return "?" + " ".join(w)


# --- persons ---------------------------------------------------------------------------------------------------------


_TOKEN = re.compile(r"([^\W_]+)(\.?)")


def person_tokens(value: str) -> tuple[list[tuple[str, bool]], bool]:
    """The words of a person's name in small letters, each with whether a point follows, without forms of address and
    nicknames; and whether the given name stands first by a comma."""
    v = _ASIDE.sub(" ", TITLES.sub("", consistent(value)))
    t = [(w.lower(), p == ".") for w, p in _TOKEN.findall(v)]
    head, comma, rest = v.partition(",")
    return t, bool(comma and _TOKEN.search(rest) and len(_TOKEN.findall(head)) == 1)


class Lexicon:
    """Words by spelling, by spelling without marks, and by deletions of the latter."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.bare: dict[str, list[str]] = defaultdict(list)
        self.near = Index(1)
        self.begun: dict[str, list[tuple[float, str]]] = {}
        for w in sorted(words, key=lambda x: (-words[x], x)):
            self.bare[strip_marks(w)].append(w)
            self.near.add(strip_marks(w), w)

    def find(self, t: str) -> list[tuple[float, str]]:
        if t in self.words:
            return [(0.0, t)]
        b = strip_marks(t)
        if b in self.bare:
            return [(0.02 if b == t else 0.3, w) for w in self.bare[b]]
        return [(0.9 + distance(t, w, 4) / 10, w) for d, k, w in self.near.find(b)] if len(b) > 1 else []

    def starts(self, t: str) -> list[tuple[float, str]]:
        if t not in self.begun:
            self.begun[t] = self._starts(t)
        return self.begun[t]

    def _starts(self, t: str) -> list[tuple[float, str]]:
        return [(0.3 if w.startswith(t) else 0.45, w) for w in self.words if w.startswith(t) or strip_marks(w).startswith(strip_marks(t)) and t == strip_marks(t)]


class Persons:
    """Family and given names learned from values; candidates() aligns a value."""

    def __init__(self, counts: dict[tuple[str, str], int], total: int):
        """counts: rows of (first, word), (last, word) and (every, word)."""
        every = {w: n for (k, w), n in counts.items() if k == "every"}
        at = lambda kind: {w: n for (k, w), n in sorted(counts.items()) if k == kind and len(w) > 1}
        fam = {w: n for w, n in at("first").items() if n >= max(2, FAMILY_SHARE * total) and n > 0.5 * every[w]}
        giv = {w: n for w, n in at("last").items() if n >= max(2, GIVEN_SHARE * total) and n > 0.4 * every[w] and w not in fam}
        self.families, self.givens = Lexicon(_spelt(fam, 8)), Lexicon(_spelt(giv, 8))

    def candidates(self, value: str) -> list[tuple[str, str, str, float]]:
        """(family, given, middle names, cost) of every reading of a value, best first."""
        t, turned = person_tokens(value)
        w = [x for x, _ in t]
        out: dict[tuple[str, str, str], float] = {}
        if len(w) < 2:
            return []
        orders = [(1, 0, w[2:], 0.0)] if turned else [(0, len(w) - 1, w[1:-1], 0.0), (1, 0, w[2:], 0.05)]
        for f, g, mid, c in orders:
            short = t[f][1] or len(w[f]) == 1
            fams = self.families.starts(w[f]) if short else self.families.find(w[f])
            givs = self.givens.find(w[g])
            for cf, x in fams:
                for cg, y in givs:
                    if cf + cg <= 1.5:
                        k = (x, y, " ".join(mid))
                        out[k] = min(out.get(k, 9.0), cf + cg + c)
        return sorted(((*k, c) for k, c in out.items()), key=lambda x: (x[3], x[:3]))


def _spelt(counts: dict[str, int], ratio: int) -> dict[str, int]:
    """Without slips and spellings without marks of words that many times more frequent."""
    bare: Counter = Counter()
    for w, n in counts.items():
        bare[strip_marks(w)] += n
    keep = _strong(dict(bare), ratio)
    top: dict[str, int] = defaultdict(int)
    for w, n in counts.items():
        top[strip_marks(w)] = max(top[strip_marks(w)], n)
    return {w: n for w, n in counts.items() if strip_marks(w) in keep and n * 4 >= top[strip_marks(w)]}


def assignment(mine: list[str], theirs: list[str]) -> float:
    """The lowest cost of assigning the middle names of a value to those of a person: initials, runs of them and slips are cheap, missing ones too."""
    if len(mine) > 4 or len(theirs) > 4:
        return 0.0 if mine == theirs else 1.0
    a, b = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
    if len(a) == 1 and len(b) > 1 and strip_marks(a[0]) == strip_marks("".join(x[0] for x in b)):
        return 0.1

    def one(x: str, y: str) -> float:
        if x == y:
            return 0.0
        if len(x) == 1 or len(y) == 1:
            return 0.1 if x[0] == y[0] else 0.15 if strip_marks(x[0]) == strip_marks(y[0]) else 1.5
        return 0.05 if strip_marks(x) == strip_marks(y) else 0.5 if distance(x, y, 1.5) <= 1.5 else OTHER

    return min((sum(one(x, y) for x, y in zip(a, p)) for p in itertools.permutations(b, len(a))), default=0.0) + 0.05 * (len(b) - len(a))


def apart(mids: list[str]) -> list[str]:
    """Of middle names of one family and given name, the most frequent first, those no earlier one can be assigned to: other persons."""
    kept: list[str] = []
    for m in mids:
        if all(assignment(m.split(), k.split()) >= OTHER for k in kept):
            kept.append(m)
    return kept


# --- linking ---------------------------------------------------------------------------------------------------------


def _sums(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"))


def learn_bodies(values: DataFrame) -> Bodies:
    """Kinds and places of all values (value, n). What is collected has a share of the rows, so its number is bounded."""

    def beginnings(batches):
        for pdf in batches:
            out = []
            for v, n in zip(pdf["value"], pdf["n"]):
                w = fold(v) if "-" not in v else []
                if w:
                    out.append(("", "", "", n))
                out += [(" ".join(w[:i]), w[i], " ".join(w[i + 1 :]), n) for i in range(2, len(w))]
            yield pd.DataFrame(out, columns=["p", "x", "rest", "n"])

    three = written(_sums(values.select("value", "n").mapInPandas(beginnings, "p string, x string, rest string, n long"), ["p", "x", "rest"]), "beginnings")
    total = three.where("p = ''").agg(F.sum("n")).collect()[0][0] or 1
    two = _sums(three.where("p <> ''"), ["p", "x"]).withColumnRenamed("n", "k")
    often = two.groupBy("p").agg(F.sum("k").alias("all")).where(F.col("all") >= KIND_SHARE * total)
    order = Window.partitionBy("p").orderBy(F.desc("k"), "x")
    top = two.join(often, "p").withColumn("r", F.row_number().over(order)).where("r <= 2")
    ends = three.join(top, ["p", "x"]).groupBy("p", "x", "k", "all").agg(F.count_if(F.col("n") >= 0.05 * F.col("k")).alias("ends"))
    # several words may follow a kind, and each begins one place or two
    kinds = ends.groupBy("p", "all").agg(F.count("*").alias("m"), F.min("k").alias("least"), F.max("ends").alias("ends")).where("m = 2 AND least >= 0.05 * all AND ends <= 3")
    model = Bodies({tuple(r.p.split(" ")): r["all"] for r in kinds.collect()})
    heads = values.sparkSession.sparkContext.broadcast(model.heads)

    def cut(batches):
        for pdf in batches:
            out = []
            for v, n in zip(pdf["value"], pdf["n"]):
                w = fold(v) if "-" not in v else []
                out += [(compact(w[:i]), compact(w[i:]), n) for i in range(2, len(w)) if tuple(w[:i]) in heads.value]
            yield pd.DataFrame(out, columns=["kind", "place", "n"])

    pairs = _sums(values.select("value", "n").mapInPandas(cut, "kind string, place string, n long"), ["kind", "place"]).where(F.col("n") >= PLACE_SHARE * total)
    model.learn_places({(r.kind, r.place): r.n for r in pairs.collect()})
    return model


def learn_persons(values: DataFrame) -> Persons:
    """Family and given names of all values (value, n); what is collected has a share of the rows."""

    def words(batches):
        for pdf in batches:
            out = []
            for v, n in zip(pdf["value"], pdf["n"]):
                w, turned = person_tokens(v)
                if turned or len(w) < 2 or any(p for _, p in w):
                    continue
                out += [("total", "", n), ("first", w[0][0], n), ("last", w[-1][0], n), *(("every", t, n) for t, _ in w)]
            yield pd.DataFrame(out, columns=["kind", "word", "n"])

    counts = written(_sums(values.select("value", "n").mapInPandas(words, "kind string, word string, n long"), ["kind", "word"]), "words")
    total = counts.where("kind = 'total'").agg(F.sum("n")).collect()[0][0] or 1
    return Persons({(r.kind, r.word): r.n for r in counts.where(F.col("n") >= max(2, GIVEN_SHARE * total)).collect()}, total)


def body_entities(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """values: (value, n). (value, entity). known: names (value) of bodies that may help to learn the words."""
    learn = values.select("value", "n")
    if known is not None:
        learn = learn.unionByName(known.where("value IS NOT NULL").select("value", F.lit(1).cast("long").alias("n")))
    model = values.sparkSession.sparkContext.broadcast(learn_bodies(learn))

    def run(batches):
        m = model.value
        for pdf in batches:
            yield pd.DataFrame({"value": pdf["value"], "entity": [m.parse(v) for v in pdf["value"]]}, dtype="object")

    return values.select("value").mapInPandas(run, "value string, entity string")


def person_entities(values: DataFrame) -> DataFrame:
    """values: (value, n). (value, entity): family and given name, and the middle names of the person the value's are assigned to."""
    model = values.sparkSession.sparkContext.broadcast(learn_persons(values))

    def read(batches):
        m = model.value
        for pdf in batches:
            out = []
            for v, n in zip(pdf["value"], pdf["n"]):
                got = m.candidates(v)
                out += [(v, n, *c, len(got)) for c in got] or [(v, n, None, None, None, 9.0, 0)]
            yield pd.DataFrame(out, columns=["value", "n", "family", "given", "mid", "cost", "k"])

    readings = written(values.select("value", "n").mapInPandas(read, "value string, n long, family string, given string, mid string, cost double, k long"), "readings")
    sure = readings.where("cost = 0 AND length(mid) >= 2 AND NOT mid RLIKE '(^| ).( |$)'")
    rows = sure.groupBy("family", "given", "mid").agg(F.sum("n").alias("rows")).withColumn("all", F.sum("rows").over(Window.partitionBy("family", "given")))

    def persons(pdf):  # at most 1 / MID_SHARE rows
        pdf = pdf.sort_values(["rows", "mid"], ascending=[False, True])
        return pdf[pdf["mid"].isin(apart(pdf["mid"].tolist()))][["family", "given", "mid", "rows"]]

    frequent = rows.where(F.col("rows") >= MID_SHARE * F.col("all")).select("family", "given", "mid", "rows")
    known = frequent.groupBy("family", "given").applyInPandas(persons, "family string, given string, mid string, rows long").withColumnRenamed("mid", "theirs")

    def align(batches):
        for pdf in batches:
            c = [assignment(a.split(), b.split()) if isinstance(b, str) else 0.6 for a, b in zip(pdf["mid"], pdf["theirs"])]
            who = [b if isinstance(b, str) and x < OTHER else strip_marks(a) if isinstance(b, str) else "" for a, b, x in zip(pdf["mid"], pdf["theirs"], c)]
            yield pdf.assign(cost=pdf["cost"] + c, who=who)[["value", "family", "given", "who", "cost", "rows"]]

    joined = readings.where("family IS NOT NULL").join(known, ["family", "given"], "left").select("value", "family", "given", "mid", "cost", "theirs", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    scored = joined.mapInPandas(align, "value string, family string, given string, who string, cost double, rows long")
    best = Window.partitionBy("value").orderBy("cost", F.desc("rows"), "family", "given", "who")
    chosen = scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("value", F.concat_ws("|", "family", "given", "who").alias("entity"))

    @F.pandas_udf("string")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda v: "?" + " ".join(strip_marks(w) for w, _ in person_tokens(v)[0]))

    rest = readings.where("family IS NULL").select("value", words("value").alias("entity"))
    return chosen.unionByName(rest)


def value_counts(df: DataFrame, expr: str) -> DataFrame:
    v = df.select(F.expr(expr).alias("value")).where(F.length(F.regexp_replace("value", r"(?U)\s", "")) > 0)
    return v.groupBy("value").agg(F.count("*").alias("n"))


def entities(df: DataFrame, bodies: dict[str, str], persons: dict[str, str], known: DataFrame | None = None) -> DataFrame:
    """(field, value, n, entity) of the distinct non-blank values."""
    out = None
    for fields, f in ((bodies, lambda v: body_entities(v, known)), (persons, person_entities)):
        for name, expr in fields.items():
            v = written(value_counts(df, expr), "values")
            one = v.join(f(v), "value").select(F.lit(name).alias("field"), "value", "n", "entity")
            out = one if out is None else out.unionByName(one)
    return out


def classes(ents: DataFrame) -> DataFrame:
    """(field, value, entity, n, n_links): every spelling with its entity and the number of other spellings of it."""
    size = ents.groupBy("field", "entity").agg((F.count("*") - 1).alias("n_links"))
    return ents.join(size, ["field", "entity"]).select("field", "value", "entity", "n", "n_links")


def linked(ents: DataFrame) -> DataFrame:
    """(field, name_a, name_b): every pair of different values of a field that name the same entity."""
    e = ents.select("field", "entity", "value")
    a, b = e.withColumnRenamed("value", "name_a"), e.withColumnRenamed("value", "name_b")
    return a.join(b, ["field", "entity"]).where("name_a < name_b").select("field", "name_a", "name_b")

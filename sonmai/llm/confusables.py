"""Visually identical text with different characters: the confusables skeleton.

Method: decompose, replace every character by its prototype from a look-alike table, decompose again; originals with
equal skeletons are one group. The consistent form recomposes the prototype text with composed Vietnamese letters.

Defined results: NULL stays NULL, '' stays ''. Line breaks, tabs and typographic quotes and dashes are ordinary. A
letter of another script is replaced inside words that mix it with Latin letters, if all its letters there have a Latin
prototype in Unicode's table of confusables, and in words wholly of it if all are in the fixed table below, so words of
another script used in their own right stay. Texts of any length are processed whole. Extra columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache

# Letters of other scripts, and Latin letters from outside Vietnamese, with the letter of the same look.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "α": "a", "τ": "t", "χ": "x", "γ": "y", "η": "n", "μ": "u", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "Տ": "S", "Ս": "U", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g",
    "Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ⅼ": "l",
}
# Characters that cannot be seen, and spaces other than the ordinary one.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufe00\ufe0e\ufe0f\ufeff\uffa0"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Compatibility forms of the same look, by the tag of their decomposition. Others (fractions, superscripts, …) are signs in their own right.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_SHAPE = "\u0302\u0306\u031b"  # circumflex, breve, horn: part of the letter, before any tone

#: Ordinary characters: ASCII, composed Vietnamese, and signs that stand for themselves. Anything else is looked at.
PLAIN = r"\x00-\x7e\u00a1-\u00ac\u00ae-\u00cf\u00d1-\u00ef\u00f1-\u0130\u0132-\u0188\u018a-\u024f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e"
#: The look-alikes and letters that only count within a word of them.
_ODD = re.compile(f"[^{PLAIN}]")
_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_MARKED = re.compile(r"[^\W\d_][\u0300-\u036f]+")


def _script(c: str) -> str:
    """The script of a letter, by the first word of its name."""
    return "LATIN" if ord(c) < 0x370 or 0x1E00 <= ord(c) < 0x1F00 else unicodedata.name(c, "?").split(" ", 1)[0]


def _same_look(c: str) -> str:
    d = unicodedata.decomposition(c)
    if d.startswith(SAME_LOOK) or (d.startswith("<compat>") and 0xFB00 <= ord(c) <= 0xFB06):
        return unicodedata.normalize("NFKC", c)
    return c


def _marks(m: re.Match) -> str:
    marks = sorted(dict.fromkeys(m.group()[1:]), key=lambda c: c not in _SHAPE)  # the letter's own marks, then the tone
    return m.group()[0] + "".join(marks)


class Forms:
    """Consistent forms under a table of look-alikes: the fixed ones everywhere, those of more within words that mix scripts."""

    def __init__(self, more: dict[str, str] | None = None):
        self.more = {**(more or {}), **LOOKALIKES}
        self.tokens = Cache(self.token, 100_000)

    def word(self, m: re.Match) -> str:
        w = m.group()
        letters = [c for c in w if not unicodedata.combining(c)]
        scripts = {_script(c) for c in letters}
        if "LATIN" in scripts and len(scripts) > 1:  # a word that mixes scripts
            if all(_script(c) == "LATIN" or c in self.more for c in letters):
                return "".join(self.more.get(c, c) for c in w)
        own = {_script(c) for c in letters if _script(c) != "LATIN" and c not in LOOKALIKES}
        if own and all(_script(c) in own for c in letters):  # a word of another script
            return w
        if len(w) == 1 and w in "αβγηιμνρτυχκ":  # a single small Greek letter is a sign
            return w
        return "".join(LOOKALIKES.get(c, c) for c in w)

    def token(self, t: str) -> str:
        if t.isascii() or (not _ODD.search(t) and unicodedata.is_normalized("NFC", t)):
            return t
        t = _WORD.sub(self.word, unicodedata.normalize("NFD", "".join(map(_same_look, t))))
        return unicodedata.normalize("NFC", _MARKED.sub(_marks, t).replace("D\u0335", "Đ").replace("d\u0335", "đ"))

    def consistent(self, s: str | None) -> str | None:
        if not s:
            return s
        s = _SPACE.sub(" ", _UNSEEN.sub("", s))
        return " ".join([self.tokens[t] if len(t) < 64 else self.token(t) for t in s.split(" ")])

    def skeleton(self, s: str | None) -> str | None:
        """Decomposed, each character replaced by its prototype wherever it stands, decomposed again."""
        if not s:
            return s
        s = unicodedata.normalize("NFD", "".join(map(_same_look, _SPACE.sub(" ", _UNSEEN.sub("", s)))))
        s = unicodedata.normalize("NFD", "".join([self.more.get(c, c) for c in s]))
        return _MARKED.sub(_marks, s).replace("Đ", "D\u0335").replace("đ", "d\u0335")


PLAIN_FORMS = Forms()


def unicode_table(spark: SparkSession) -> dict[str, str]:
    """Letters outside Latin and the ASCII letter of the same prototype in Unicode's table of confusables, as the ICU library in
    Spark's own class path has it. Of fixed size; where several letters share a prototype, the one of the same case."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()

    def prototypes(chars: list[str]) -> list[str]:
        out = []
        for i in range(0, len(chars), 4000):
            out += checker.getSkeleton("\n".join(chars[i : i + 4000])).split("\n")
        return out

    ascii_ = [chr(o) for o in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    of: dict[str, list[str]] = {}
    for c, p in zip(ascii_, prototypes(ascii_)):
        of.setdefault(p, []).append(c)
    others = [c for c in map(chr, range(0x370, 0x20000)) if unicodedata.category(c)[0] in "LN" and unicodedata.category(c) not in ("Nd", "No") and _script(c) != "LATIN" and unicodedata.is_normalized("NFD", c)]
    table = {}
    for c, p in zip(others, prototypes(others)):
        twins = of.get(p)
        if twins:
            table[c] = next((x for x in twins if x.isupper() == c.isupper()), twins[0])
    return table


_UNSEEN, _SPACE = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{SPACES}]")


def consistent(s: str | None, odd: bool | None = None) -> str | None:
    """The one consistent form of a text under the fixed look-alikes. odd: what suspicious() says of it, where that is known."""
    return PLAIN_FORMS.consistent(s) if s and (_ODD.search(s) if odd is None else odd) else s


def skeleton(s: str | None) -> str | None:
    """The skeleton of a text under the fixed look-alikes."""
    return PLAIN_FORMS.skeleton(s)


def suspicious(c: Column) -> Column:
    """JVM-side prefilter: the value holds a character that may need work; all others are in their consistent form already."""
    return c.rlike(f"[^{PLAIN}]")


def _byte_pairs() -> np.ndarray:
    """By the first two bytes of a character in UTF-8: 1 where it is suspicious, 2 where the third byte tells."""
    t = np.zeros(65536, np.uint8)
    plain = re.compile(f"[{PLAIN}]")
    for hi in range(0xC2, 0xE0):
        for lo in range(0x80, 0xC0):
            t[hi << 8 | lo] = not plain.match(chr((hi & 0x1F) << 6 | lo & 0x3F))
    for hi in range(0xE0, 0xF0):
        for lo in range(0x80, 0xC0):
            n = [bool(plain.match(chr((hi & 0xF) << 12 | (lo & 0x3F) << 6 | x))) for x in range(64)]
            t[hi << 8 | lo] = 0 if all(n) else 2 if any(n) else 1
    t[0xF000:0xF800] = 1
    return t


_PAIRS = _byte_pairs()
_THIRD = np.array([[not re.match(f"[{PLAIN}]", chr(0x2000 | k << 6 | x)) for x in range(64)] for k in range(64)])


def odd_flags(column: pa.Array) -> list[bool]:
    """suspicious() of each text of an Arrow column, from its bytes; no text is decoded."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return []
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    out = np.zeros(n, bool)
    if data is None or o[-1] - o[0] < 2:
        return out.tolist()
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]]
    kind = _PAIRS[b[:-1].astype(np.uint16) << np.uint16(8) | b[1:]]
    at = np.flatnonzero(kind)
    if len(at):
        maybe = kind[at] == 2
        third = b[np.minimum(at + 2, len(b) - 1)] & 0x3F
        at = at[~maybe | (b[at] != 0xE2) | _THIRD[b[at + 1] & 0x3F, third]]
        out[np.searchsorted(o - o[0], at, "right") - 1] = True
    return out.tolist()


def _apply(method: str, more: dict[str, str]):
    """A UDF of one method of the forms under a table, which is of fixed size and travels with the function."""

    @F.pandas_udf("string")
    def g(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = getattr(Forms(more), method)
        for s in it:
            yield s.map(f, na_action="ignore")

    return g


def consistent_column(c: Column, more: dict[str, str]) -> Column:
    """Only values with an unusual character travel to Python; the others stay in the JVM."""
    odd = suspicious(c)
    return F.when(odd, _apply("consistent", more)(F.when(odd, c))).otherwise(c)


def with_consistent(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the consistent form of each value: {new column: expression of the value}."""
    more = unicode_table(df.sparkSession)
    return df.withColumns({new: consistent_column(F.expr(old), more) for new, old in columns.items()})


def inconsistent_values(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row (key, field, value, consistent) for each value that isn't the plainest of those with its skeleton.

    The plainest spelling of a skeleton is the consistent form; a value that differs from it and has its skeleton is coded
    otherwise.
    """
    more = unicode_table(df.sparkSession)

    @F.pandas_udf("consistent string, same boolean")
    def looked_at(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forms = Forms(more)
        for s in it:
            c = [forms.consistent(x) for x in s]
            yield pd.DataFrame({"consistent": c, "same": [x == y or forms.skeleton(x) == forms.skeleton(y) for x, y in zip(s, c)]})

    long = df.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.expr(e).alias("value")) for n, e in fields.items()])))
    long = long.where(F.col("value").isNotNull() & suspicious(F.col("value"))).withColumn("looked", looked_at("value"))
    return long.where("looked.same AND NOT (value <=> looked.consistent)").select(key, "field", "value", "looked.consistent")


def skeleton_groups(df: DataFrame, value: str) -> DataFrame:
    """Distinct originals of a column grouped by equal skeleton: (skeleton, consistent, n_rows, n_spellings); groups of one spelling are kept.

    Rows are counted per spelling first, so a spelling that a third of all rows hold is one row before the second
    shuffle, and no group is gathered anywhere.
    """
    more = unicode_table(df.sparkSession)
    spelt = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    spelt = spelt.withColumn("skeleton", _apply("skeleton", more)("v")).withColumn("c", consistent_column(F.col("v"), more))
    return spelt.groupBy("skeleton").agg(F.min("c").alias("consistent"), F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))

"""Noise in text from scanned pages: repair into continuous, readable paragraphs.

Method: noisy-channel correction. Corpus counts of words and word pairs give the n-gram likelihood; character confusion
probabilities, re-estimated from the corpus, give the channel; each line with a doubtful word is decoded by Viterbi over
the candidate words of its tokens. Page furniture is found by structure: page-number forms, and lines that repeat between
the lines of a document or have the form of such a line elsewhere in the corpus.

Defined results: NULL and blank texts have no damage and come out unchanged, as does a text without a trace of pages: no
line runs on in the next, no page number stands between lines, and it isn't made of many short lines. The names at its
beginning and end are spelt as people typed them and are not corrected; sentences there are. Whole texts are read, of any length.
Corpus counts cover all rows; the model keeps what occurs in at least a fixed share of rows, so its size is bounded by
the mean row, not by their number. Repeated rows count as often as they stand. Extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BARE_LETTERS, Cache, strip_marks
from .confusables import consistent, odd_flags

# What the characters of a scan are misread as.
CONFUSIONS = (("n", "ri"), ("h", "li"), ("t", "f"), ("i", "1"), ("g", "9"), ("u", "ii"), ("c", "("), ("ư", "u'"), ("đ", "cl"), ("d", "cl"), ("o", "0"), ("b", "6"), ("l", "1"), ("m", "rn"), ("v", "y"))
#: The forms a page number takes on a line of its own.
PAGE_FORMS = re.compile(r"-\s*\d{1,4}\s*-|—\s*\d{1,4}\s*—|tr\.\s*\d{1,4}|[Tt]rang \d{1,4}(?:/\d{1,4})?|Page \d{1,4} of \d{1,4}|\[\d{1,4}\]|\d{1,3}|\d{1,4} \| \d{1,4}")
_PAGE_END = re.compile(r"\s{2,}(?:" + PAGE_FORMS.pattern + r")$")
_HYPHEN = re.compile(r"([^\W\d_]['.(]?)(?:[-=¬] ?)$")
#: What a word cut at a line end ends in.
HYPHENS = ("-", "=", "¬")
_LOWER = re.compile(r"\s*[^\W\d_A-ZÀ-ÝĂĐĨŨƠƯẠ-Ỹ]|\s*[ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹăđĩũơư]")
_EDGE = ".,;:!?\"“”‘’)[]|…"
#: A word belongs to the lexicon from this share of the rows on, a word pair from this one.
WORD_SHARE, PAIR_SHARE = 3e-4, 1e-4
#: A word this many times rarer than one it may be a misreading of is no word of the lexicon.
RARER = 200
WRAP, LEAST = 100, 36  # lines of a scan are shorter than this; one that runs on is at least so long

_TONES = ("aàảãáạ", "ăằẳẵắặ", "âầẩẫấậ", "eèẻẽéẹ", "êềểễếệ", "iìỉĩíị", "oòỏõóọ", "ôồổỗốộ", "ơờởỡớợ", "uùủũúụ", "ưừửữứự", "yỳỷỹýỵ")
_FAMILY = {"a": "aăâ", "e": "eê", "i": "i", "o": "oôơ", "u": "uư", "y": "y"}
_TONE_OF = {c: (row, t) for row in _TONES for t, c in enumerate(row)}


_FOLD = {o: " " for o in range(0x21, 0x80) if not chr(o).isalnum()} | {ord(c): "#" for c in "23457８"} | {ord(x): y for x, y in zip("f1906(y8", "tigobcv#")}
_FOLD |= {o: {"f": "t", "y": "v"}.get(c, c) for o, c in BARE_LETTERS.items()} | {ord(c): " " for c in "“”‘’–—…"}


def _fold_line(s: str) -> str:
    """A key under which misreadings of one line mostly agree: no marks, case, punctuation or digits."""
    s = s.lower().translate(_FOLD)
    for a, b in (("rn", "m"), ("ri", "n"), ("li", "h"), ("ii", "u"), ("ci", "d")):
        s = s.replace(a, b)
    return " ".join(s.split())


_FOLDED = Cache(_fold_line, 50_000)


def is_page(lines: list[str]) -> bool:
    return len(lines) >= 8 and max(map(len, lines)) < WRAP


def runs_on(line: str, after: str) -> bool:
    """Whether a line as long as a page's goes on in the next one."""
    end = line.rstrip()
    return LEAST <= len(line) < WRAP and len(after) < WRAP and (end[-1].isalpha() or end[-1] in HYPHENS or end[-1] == ",") and bool(_LOWER.match(after))


def is_scan(lines: list[str]) -> bool:
    """Hard-wrapped as by a page: many lines and no long one; or, in texts of any size, a line that runs on in the next one, or
    a page number between lines."""
    if is_page(lines):
        return True
    last = len(lines) - 1
    for i, line in enumerate(lines):
        if i < last and runs_on(line, lines[i + 1]):
            return True
        s = line.strip()
        if 0 < i < last and len(s) <= 16 and s and not s.isdigit() and PAGE_FORMS.fullmatch(s):
            return True
    return False


def furniture(lines: list[str], forms: frozenset | set = frozenset()) -> tuple[set[int], set[int]]:
    """The indexes of running headers and of page numbers among the lines of one scan. forms: beginnings of headers."""
    pages, keys, heads = set(), {}, set()
    lone = []
    start = lines[0].lstrip()[:1].lower()
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            continue
        if i and len(s) <= 16 and PAGE_FORMS.fullmatch(s):
            (lone.append((i, int(s))) if s.isdigit() else pages.add(i))
            continue
        m = _PAGE_END.search(s) if i > 2 and "  " in s and (s[-1].isdigit() or s[-1] in "]-—") else None
        if m:
            pages.add(i)
            heads.add(i)
            s = s[: m.start()]
        c = s[0]
        if c.isupper() or c.isdigit() or c == start or m:  # lines that begin in small letters run on, but for the title's own spelling
            keys[i] = _FOLDED[s]
    # a bare number is a page number where such numbers follow one another, or is the first or second page
    if lone and all(b[1] - a[1] == 1 for a, b in zip(lone, lone[1:])) and lone[0][1] <= 3 and (len(lone) > 1 or lone[0][1] <= 2):
        pages.update(i for i, _ in lone)
    n = Counter(keys.values())
    title = keys.get(0, "")
    for i, k in keys.items():
        if i < 2 or len(k) < 5 or i in heads:
            continue
        s = lines[i].strip()
        if " " not in k and "/" not in s and n[k] < 3:
            continue
        first = s[0].isupper() or s[0].isdigit()
        if n[k] > 1 and ((first and (s[-1] not in ";," and (s[-1] != "." or len(k) > 15))) or k == title) and not k.startswith(("noi nhan", "luu ")):
            heads.add(i)
        elif i > 4 and (k == title or (first and i < len(lines) - 1 and (" ".join(k.split()[:3]) in forms) and s[-1] not in ";,:")):
            heads.add(i)
    # the first of equal lines may be the letterhead itself
    return {i for i in heads if not (i <= 6 and n[keys.get(i, "")] == 1 and i not in pages and keys.get(i) != title)}, pages


def clean_lines(text: str, forms=frozenset()) -> list[str]:
    """The lines of a text without page furniture, words cut at line ends joined."""
    lines = text.split("\n")
    if not is_scan(lines):
        return lines
    heads, pages = furniture(lines, forms)
    out: list[str] = []
    for i, line in enumerate(lines):
        if i in heads or i in pages:
            continue
        if out and out[-1].rstrip()[-1:] in HYPHENS and (m := _HYPHEN.search(out[-1])) and _LOWER.match(line):
            out[-1] = out[-1][: m.end(1)] + line.lstrip()
        else:
            out.append(line)
    return out


# --- the model -------------------------------------------------------------------------------------------------------


def _bare(token: str) -> str:
    """A token without outer punctuation, in lower case; a parenthesis that stands for a c stays."""
    t = token.strip(_EDGE)
    if t[:1] == "(" and (len(t) < 2 or not t[1].islower()):
        t = t[1:]
    return t.lower()


_DIGITS = re.compile(r"[\d.,/%:-]+")


def _key(token: str) -> str:
    b = _bare(token)
    return "#" if _DIGITS.fullmatch(b) else b


_KEYS = Cache(_key)


def corpus_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(kind, a, b, n): rows holding a word (w), occurrences of a pair of words (p), rows with a header form (h), rows (r).

    Counted within each task first, so what is shuffled is one row per task and distinct word or pair, however
    often a text is repeated.
    """

    def count(batches):
        ids: dict[str, int] = {}
        df_n: Counter = Counter()
        forms: Counter = Counter()
        pairs: dict[int, int] = {}
        rows = 0
        token_id = Cache(lambda t: ids.setdefault(_KEYS[t], len(ids)))
        held: list[np.ndarray] = []
        size = 0

        def flush():
            if held:
                k, n = np.unique(np.concatenate(held), return_counts=True)
                for a, b in zip(k.tolist(), n.tolist()):
                    pairs[a] = pairs.get(a, 0) + b
                held.clear()

        for batch in batches:
            for t, odd in zip(batch.column(0).to_pylist(), odd_flags(batch.column(0))):
                rows += 1
                if not t:
                    continue
                t = consistent(t, odd)
                lines = t.split("\n")
                if is_scan(lines):
                    heads, pages = furniture(lines)
                    forms.update({" ".join(_FOLDED[lines[i].strip()].split()[:3]) for i in heads})
                    t = "\n".join(clean_lines(t))
                a = np.fromiter(map(token_id.__getitem__, t.split()), np.int64)
                df_n.update(np.unique(a).tolist())
                if len(a) > 1:
                    held.append(a[:-1] << 32 | a[1:])
                    size += len(a)
                if size > 3_000_000:
                    flush()
                    size = 0
        flush()
        names = list(ids)
        out = [("r", "", "", rows)] + [("w", names[i], "", n) for i, n in df_n.items() if len(names[i]) < 40] + [("h", f, "", n) for f, n in forms.items()]
        out += [("p", names[k >> 32], names[k & 0xFFFFFFFF], n) for k, n in pairs.items() if len(names[k >> 32]) < 40 and len(names[k & 0xFFFFFFFF]) < 40]
        for i in range(0, len(out), 100_000):
            k, a, b, n = zip(*out[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["kind", "a", "b", "n"])

    src = df.where(F.col(text).isNotNull()).select(text)
    return src.mapInArrow(count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def variants(word: str):
    """(misreading, confusion) of one word with one confusion."""
    for a, b in CONFUSIONS:
        i = word.find(a)
        while i >= 0:
            yield word[:i] + b + word[i + len(a) :], a + ">" + b
            i = word.find(a, i + 1)
    if not word.isascii():
        yield strip_marks(word), "marks"
        for i, c in enumerate(word):
            if c in _TONE_OF:
                row, t = _TONE_OF[c]
                if t == 5:
                    yield word[:i] + row[0] + "." + word[i + 1 :], "dot"
                for other in _FAMILY.get(strip_marks(c), ""):
                    for x in next(r for r in _TONES if r[0] == other):
                        if x != c:
                            yield word[:i] + x + word[i + 1 :], "mark"
            elif c == "đ":
                yield word[:i] + "d" + word[i + 1 :], "mark"


class Model:
    """Lexicon, pair likelihoods, candidate index and channel probabilities; of bounded size, built once on the driver."""

    def __init__(self, counts):
        words = {r.a: r.n for r in counts if r.kind == "w"}
        self.rows = sum(r.n for r in counts if r.kind == "r")
        alpha = {w: n for w, n in words.items() if w and not w.isdigit() and re.fullmatch(r"[^\W\d_]+", w)}
        index = defaultdict(list)
        for w, n in alpha.items():
            for v, op in variants(w):
                index[v].append((w, op))
        rarer = min(RARER, max(12.0, self.rows / 30))  # in few rows no word is so much rarer

        def noise(w):
            return any(alpha[b] > rarer * alpha[w] and (op != "mark" or alpha[b] > 10 * rarer * alpha[w]) for b, op in index.get(w, ()))
        self.lexicon = {w: n for w, n in alpha.items() if not noise(w)}
        ops: Counter = Counter()
        for v, bases in index.items():
            if v not in self.lexicon and v in words:
                w, op = max(bases, key=lambda x: (alpha[x[0]], x))
                if w in self.lexicon:
                    ops[op] += words[v]
        total = sum(ops.values()) + 1.0
        error = total / (sum(alpha.values()) + 1.0)  # the share of misread words
        kinds = {op for b in index.values() for _, op in b}
        self.channel = {op: math.log((ops[op] + 0.5) / (total + 0.5 * len(kinds)) * min(0.02, max(error, 1e-4))) for op in kinds}
        self.index = {v: [(w, op) for w, op in b if w in self.lexicon] for v, b in index.items()}
        self.index = {v: b for v, b in self.index.items() if b}
        self.pairs = {(r.a, r.b): r.n for r in counts if r.kind == "p"}
        self.words = {w: n for w, n in words.items() if w in self.lexicon or w == "#"}
        self.total = float(sum(self.words.values()) + 1)
        self.forms = frozenset(r.a for r in counts if r.kind == "h" and r.a)
        self.inverse = [(b, a) for a, b in CONFUSIONS]

    def candidates(self, token: str) -> list[tuple[str, float]]:
        """Words the token may be a misreading of, with the channel's log probability; two confusions at most."""
        found: dict[str, float] = {}
        for w, op in self.index.get(token, ()):
            found[w] = max(found.get(w, -99.0), self.channel[op])
        if not found and len(token) < 40:
            for b, a in self.inverse:
                i = token.find(b)
                while i >= 0:
                    t = token[:i] + a + token[i + len(b) :]
                    p = self.channel.get(a + ">" + b, -12.0)
                    if t in self.lexicon:
                        found[t] = max(found.get(t, -99.0), p)
                    for w, op in self.index.get(t, ()):
                        found[w] = max(found.get(w, -99.0), p + self.channel[op] + 4.0)
                    i = token.find(b, i + 1)
        return list(found.items())

    def logp(self, a: str, b: str) -> float:
        n = self.words.get(a, 0)
        uni = (self.words.get(b, 0) + 0.01) / self.total
        return math.log(0.9 * self.pairs.get((a, b), 0) / n + 0.1 * uni) if n else math.log(0.1 * uni)


def build_model(df: DataFrame, key: str, text: str) -> Model:
    """Counts of the whole table; what is collected is bounded by the shares, not by the number of rows."""
    c = corpus_counts(df, key, text)
    n = F.col("n")
    rows = df.where(F.col(text).isNotNull()).count()
    keep = c.where(
        (F.col("kind") == "r")
        | ((F.col("kind") == "w") & (n >= max(2, WORD_SHARE * rows)))
        | ((F.col("kind") == "h") & (n >= max(2, WORD_SHARE * rows)))
        | ((F.col("kind") == "p") & (n >= max(2, PAIR_SHARE * rows)))
    )
    return Model(keep.collect())


# --- repair ----------------------------------------------------------------------------------------------------------

_OWN = 1e-7  # probability of a word outside the lexicon


def _decode(model: Model, toks: list[str], keys: list[str], doubtful: set[int]) -> dict[int, str]:
    """Viterbi over the candidate words of one line; returns the corrected tokens by position."""
    states: list[list[tuple[str, float]]] = []
    for i, k in enumerate(keys):
        own = [(k, 0.0 if k in model.words else math.log(_OWN))]
        states.append(own + model.candidates(k) if i in doubtful else own)
    best = [(e + (math.log((model.words.get(w, 0) + 0.01) / model.total) if w in model.words else 0.0), None) for w, e in states[0]]
    back = []
    for i in range(1, len(states)):
        nxt, ptr = [], []
        for w, e in states[i]:
            s = [(b[0] + (model.logp(states[i - 1][j][0], w) if w in model.words else 0.0), j) for j, b in enumerate(best)]
            top = max(s)
            nxt.append((top[0] + e, None))
            ptr.append(top[1])
        best = nxt
        back.append(ptr)
    j = max(range(len(best)), key=lambda x: (best[x][0], -x))
    fixed = {}
    for i in range(len(states) - 1, -1, -1):
        if states[i][j][0] != keys[i]:
            fixed[i] = states[i][j][0]
        if i:
            j = back[i - 1][j]
    return fixed


def _recase(token: str, key: str, word: str) -> str:
    i = token.lower().find(key)
    if i < 0:
        return word
    body = token[i : i + len(key)]
    new = word.upper() if len(word) > 1 and body.isupper() and any(c.isalpha() for c in body[1:]) else word[0].upper() + word[1:] if body[0].isupper() else word
    return token[:i] + new + token[i + len(key) :]


def _is_name(lines: list[str], i: int) -> bool:
    """Whether the first or the last line of a page may hold a name: it ends in no sentence, and none runs through it."""
    s = lines[i].strip()
    if s[-1:] in ".;,!?" or len(s) >= WRAP:
        return False
    if i == 0:
        return len(lines) < 2 or not runs_on(s, lines[1])
    return s.count(" ") < 8


def repair(text: str, model: Model, known: Cache, odd: bool = True) -> tuple[str, int, int, int, int]:
    """The repaired text and the numbers of cut words, misread words, headers and page numbers in it."""
    lines = text.split("\n")
    if not is_scan(lines):
        return text, 0, 0, 0, 0
    if odd:
        lines = consistent(text, True).split("\n")
    n_hyphen = n_chars = 0
    heads, pages = furniture(lines, model.forms)
    kept = [x for i, x in enumerate(lines) if i not in heads and i not in pages]
    last = max((i for i, x in enumerate(kept) if x.strip()), default=-1)
    width = max((len(x) for x in kept if len(x) < WRAP), default=0)
    page = is_page(lines)
    named = {i for i in (0, last) if i >= 0 and _is_name(kept, i)}
    title = _FOLDED[kept[0].strip()] if 0 in named and not kept[0].startswith("Số") else None
    out: list[str] = []
    typed: set[int] = set()  # lines that hold an agency or a signer
    free, prev = True, ""  # free: the next line begins a paragraph
    for i, line in enumerate(kept):
        if i in named or (title and len(line) < WRAP and line[:1] in "#" + kept[0][:1].lower() + kept[0][:1] and _FOLDED[line.strip()] == title):
            typed.add(len(out))
            out.append(line)
            free = False
        # words cut at the end of a line belong to the line they began on
        elif out and not free and prev.rstrip()[-1:] in HYPHENS and (m := _HYPHEN.search(out[-1])) and _LOWER.match(line):
            out[-1] = out[-1][: m.end(1)] + line.strip()
            n_hyphen += 1
        else:
            first = line.split(None, 1)
            full = len(prev.rstrip()) + 1 + len(first[0]) > width if page and first else runs_on(prev, line)
            if out and not free and first and len(out) - 1 not in typed and full:
                out[-1] += " " + line.strip()
            else:
                out.append(line)
            free = not first
        prev = line
    for at, line in enumerate(out):
        if at in typed:
            continue
        toks = line.split()
        keys = list(map(_KEYS.__getitem__, toks))
        codes = bytes(map(known.__getitem__, keys))
        if not any(codes):
            continue
        doubtful = [
            i
            for i, v in enumerate(codes)
            if v == 2 or (v == 1 and (i == 0 or (keys[i - 1], keys[i]) not in model.pairs) and (i + 1 == len(keys) or (keys[i], keys[i + 1]) not in model.pairs))
        ]
        if not doubtful:
            continue
        fixed: dict[int, str] = {}
        lo = 0
        while lo < len(doubtful):  # decode stretches: doubtful words and their neighbours
            hi = lo
            while hi + 1 < len(doubtful) and doubtful[hi + 1] - doubtful[hi] <= 2:
                hi += 1
            a, b = max(0, doubtful[lo] - 1), min(len(keys), doubtful[hi] + 2)
            got = _decode(model, toks[a:b], keys[a:b], {x - a for x in doubtful[lo : hi + 1]})
            fixed |= {a + x: w for x, w in got.items()}
            lo = hi + 1
        if fixed:
            n_chars += len(fixed)
            out[at] = " ".join(_recase(t, keys[i], fixed[i]) if i in fixed else t for i, t in enumerate(toks))
    return "\n".join(out), n_hyphen, n_chars, len(heads), len(pages)


def knowledge(model: Model) -> Cache:
    """0: leave the word, 1: a word that may be a misreading of another one, 2: no word, and it may be a misreading."""

    def of(k: str) -> int:
        if k == "#" or not k or len(k) > 40:
            return 0
        if k in model.lexicon:
            return 1 if len(model.index.get(k, ())) else 0
        if "-" in k or "/" in k or "_" in k:
            return 0
        return 2 if model.candidates(k) else 0

    return Cache(of)


def repair_texts(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, repaired, n_hyphen, n_chars, n_header, n_pageno) of every row; a narrow map once the model is there."""
    model = model or build_model(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType

    def run(batches):
        m = shared.value
        known = knowledge(m)
        for batch in batches:
            got = [repair(t, m, known, o) if t else (t, 0, 0, 0, 0) for t, o in zip(batch.column(1).to_pylist(), odd_flags(batch.column(1)))]
            cols = list(zip(*got)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:]]], ["k", "repaired", "n_hyphen", "n_chars", "n_header", "n_pageno"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, repaired string, n_hyphen int, n_chars int, n_header int, n_pageno int")


def damage_found(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, kind): a row for each kind of damage that the repair of a text removed."""
    r = repair_texts(df, key, text, model)
    kinds = F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in ("hyphen", "chars", "header", "pageno")])
    return r.select(key, F.explode(F.array_compact(kinds)).alias("kind"))

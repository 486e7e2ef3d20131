"""Matching of typed names: folding, deletion neighbourhoods, weighted Damerau–Levenshtein, abbreviations."""

from __future__ import annotations

import re
from collections import defaultdict

from .common import strip_marks
from .confusables import consistent

_WORDS = re.compile(r"[^\W_]+")


def fold(s: str) -> list[str]:
    """The words of a name without case, marks and punctuation; & counts as the word for it."""
    return _WORDS.findall(strip_marks(consistent(s)).lower().replace("&", " va "))


def compact(words: list[str]) -> str:
    return "".join(words)


def deletes(s: str, most: int) -> set[str]:
    """The string and what it becomes by deleting at most so many characters."""
    out = level = {s}
    for _ in range(most):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return out


def distance(a: str, b: str, most: float = 3.0) -> float:
    """Damerau–Levenshtein distance with neighbours swapped once; letters that differ in marks or case only cost a tenth."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > most:
        return most + 1
    fa, fb = strip_marks(a).lower(), strip_marks(b).lower()
    if len(fa) != len(a) or len(fb) != len(b):
        fa, fb = a.lower(), b.lower()
    two: list[float] = []
    one = [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [float(i)]
        for j in range(1, len(b) + 1):
            c = 0.0 if a[i - 1] == b[j - 1] else 0.1 if fa[i - 1] == fb[j - 1] else 1.0
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + c)
            if i > 1 and j > 1 and fa[i - 1] == fb[j - 2] and fa[i - 2] == fb[j - 1] and fa[i - 1] != fa[i - 2]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


class Index:
    """Symmetric-delete dictionary: entries of a bounded list by their deletion neighbourhoods."""

    def __init__(self, most: int = 1):
        self.most, self.exact, self.near = most, defaultdict(dict), defaultdict(set)

    def add(self, key: str, value, weight: float = 0.0, most: int | None = None) -> None:
        old = self.exact[key].get(value)
        self.exact[key][value] = weight if old is None else min(old, weight)
        for d in deletes(key, self.most if most is None else most):
            self.near[d].add(key)

    def find(self, key: str, most: int | None = None) -> list[tuple[float, str, object]]:
        """(distance plus weight, key, value) of the nearest entries, best first."""
        if key in self.exact:
            return sorted((w, key, v) for v, w in self.exact[key].items())
        most = self.most if most is None else most
        keys = set()
        for d in deletes(key, most):
            keys |= self.near.get(d, set())
        out = []
        for k in keys:
            n = distance(key, k, most)
            if n <= most:
                out += [(n + w, k, v) for v, w in self.exact[k].items()]
        return sorted(out, key=lambda x: (x[0], x[1], str(x[2])))


def initials(words: list[str]) -> str:
    return "".join(w[0] for w in words if w != "va")


def short_forms(kind: list[str], admin: int = 1) -> dict[str, float]:
    """Compact abbreviated forms of the words that say what kind of body it is, with a weight: the less is kept, the greater.

    Runs of words become their initials, all of them or some; the last word, which says the level, may be left out or cut.
    """
    m = len(kind)
    out: dict[str, float] = {compact(kind): 0.0}

    def add(form: str, weight: float) -> None:
        if len(form) > 1:
            out[form] = min(out.get(form, 9.0), weight)

    runs = [(i, j) for i in range(m) for j in range(i + 2, m + 1)]
    for cut in {m, m - admin} if m > admin + 1 else {m}:
        k = kind[:cut]
        add(compact(k), 0.05)
        if cut == m and m > 2:
            add(compact(k[:-1]) + k[-1][0], 0.06)
        own = [r for r in runs if r[1] <= cut]
        for i, j in own:
            add(compact(k[:i]) + initials(k[i:j]) + compact(k[j:]), 0.1)
            add(initials(k[i:j]), 0.3 + 0.05 * (cut - (j - i)))
            for a, b in own:
                if a >= j:
                    add(compact(k[:i]) + initials(k[i:j]) + compact(k[j:a]) + initials(k[a:b]) + compact(k[b:]), 0.15)
            # the first letter with the next word, as in a short word for a company
            if i == 0:
                head = k[0][0] + k[1]
                add(head + compact(k[2:]), 0.12)
                for a, b in own:
                    if a >= 2:
                        add(head + compact(k[2:a]) + initials(k[a:b]) + compact(k[b:]), 0.14)
    return out

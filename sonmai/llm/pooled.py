"""Texts as arrays of word numbers: whitespace tokens are looked up once each, and may stand for several words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Pooled:
    """words(token) gives a token's words as numbers; many texts become one array by table lookups."""

    def __init__(self, words: Callable[[str], list[int]], dtype=np.int64, most: int = 1_000_000):
        self.words, self.dtype, self.most = words, dtype, most
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = _Index(self)
        self.values: list[int] = []
        self.start: list[int] = []
        self.size: list[int] = []
        self.held = [np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)]

    def _tables(self) -> list[np.ndarray]:
        """The three lists as arrays; only what is new is converted."""
        for i, (x, t) in enumerate(((self.values, self.dtype), (self.start, np.int64), (self.size, np.int64))):
            n = len(self.held[i])
            if len(x) > n:
                self.held[i] = np.concatenate([self.held[i], np.array(x[n:], dtype=t)])
        return self.held

    def _add(self, token: str) -> int:
        w = self.words(token)
        self.start.append(len(self.values))
        self.size.append(len(w))
        self.values.extend(w)
        return len(self.start) - 1

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts end to end, and the offsets of each text's."""
        if len(self.start) > self.most:
            self._reset()
        get = self.at.__getitem__
        parts = [np.fromiter(map(get, t), np.int64, len(t)) for t in ((x.split() if x else ()) for x in texts)]
        n = np.array([len(p) for p in parts], dtype=np.int64)
        token = np.concatenate(parts) if parts else np.empty(0, np.int64)
        values, start, size = self._tables()
        k = size[token] if len(token) else np.empty(0, np.int64)
        first = np.cumsum(k) - k
        at = np.repeat(start[token] - first if len(token) else first, k) + np.arange(int(k.sum()))
        doc = np.repeat(np.repeat(np.arange(len(parts)), n), k)
        return values[at], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(parts)))]).astype(np.int64)


class _Index(dict):
    def __init__(self, owner: Pooled):
        super().__init__()
        self.owner = owner

    def __missing__(self, token: str) -> int:
        i = self[token] = self.owner._add(token)
        return i

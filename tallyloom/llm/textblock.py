"""Whole texts as arrays of code points: words, their hashes and shingles for a block of texts at a time.

A word is a longest run of characters that are neither a space nor one of U+0009 to U+000D.
"""

from __future__ import annotations

import functools

import numpy as np

# The characters between words.
BLANKS = "\t\n\x0b\x0c\r "
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers; the finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Block:
    """Some texts, one after another; a null text counts as empty. What isn't asked for isn't computed."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self.n = len(self.texts)
        #: Figures of each text (the last axis) that were asked for.
        self.known: dict[str, np.ndarray] = {}

    def take(self, which: np.ndarray) -> Block:
        """A block of some of the texts, in order, with what is computed of them already."""
        out = Block([self.texts[i] for i in which])
        if not out.n:
            return out
        out.known = {name: v[..., which] for name, v in self.known.items()}
        mine = np.zeros(self.n, bool)
        mine[which] = True
        if "chars" in self.__dict__:
            out.chars = self.chars[np.repeat(mine, np.diff(self.starts))]
        if "words" in self.__dict__:
            own = mine[self.word_text]
            moved = (out.starts[np.cumsum(mine) - 1] - self.starts[:-1])[self.word_text[own]]
            out.words = (self.words[0][own] + moved, self.words[1][own] + moved)
            if "hashes" in self.__dict__:
                out.hashes = self.hashes[own]
        return out

    @functools.cached_property
    def chars(self) -> np.ndarray:
        """All code points, a line feed after each text."""
        return points("\n".join(self.texts) + "\n")

    @functools.cached_property
    def starts(self) -> np.ndarray:
        """Where each text starts in ``chars``, and the end."""
        return np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts])]).astype(np.int64)

    @functools.cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in ``chars``."""
        c = self.chars
        inside = np.concatenate([[False], (c != 32) & ((c < 9) | (c > 13)), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]

    @functools.cached_property
    def word_starts(self) -> np.ndarray:
        """The first word of each text, and the number of words."""
        return np.searchsorted(self.words[0], self.starts)

    @functools.cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_starts)

    @functools.cached_property
    def word_text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(self.n), self.n_words)

    @functools.cached_property
    def _sums(self) -> np.ndarray:
        up, _ = self._up_down
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.chars.astype(np.uint64) + np.uint64(1)) * up[: len(self.chars)])])

    @property
    def _up_down(self) -> tuple[np.ndarray, np.ndarray]:
        return _powers(1 << max(19, (len(self.chars) + 1).bit_length()))

    def span_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch from ``a`` to ``b`` in ``chars``; equal stretches have equal hashes wherever they lie."""
        sums, down = self._sums, self._up_down[1]
        with np.errstate(over="ignore"):
            return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.span_hashes(*self.words)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window of ``k`` words inside one text, and the window's hash."""
        h, n = self.hashes, len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.word_text[: n - k + 1] == self.word_text[k - 1 :])
        out = np.zeros(n - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = (out + h[i : n - k + 1 + i]) * _BASE
                out ^= out >> np.uint64(29)
            return first, mix(out[first])

    def per_text(self, at: np.ndarray) -> np.ndarray:
        """How many of the sorted places ``at`` in ``chars`` lie in each text."""
        return np.diff(np.searchsorted(at, self.starts))

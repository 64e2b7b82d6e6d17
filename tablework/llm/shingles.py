"""64-bit hashes of words and word windows, for whole slices of texts at once.

A word's hash is a polynomial of its bytes (from running sums of powers of an
odd base, modulo 2^64), mixed; a window's hash is a polynomial of its words'
hashes, mixed.  Equal words always have equal hashes.
"""

from __future__ import annotations

import numpy as np

from tablework.llm.common import SPACES

_B = 0x9E3779B97F4A7C15
BASE = np.uint64(_B)
INVERSE = np.uint64(pow(_B, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of a slice of texts: ``hashes`` in order, and of each text the
    range ``first``..``last`` of its words."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        lo = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        edges = np.diff(np.concatenate(([True], _IS_SPACE[data])).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        if starts.size:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)), dtype=np.uint64)))
            self.hashes = mix((total[ends] - total[starts]) * _powers(INVERSE, len(data))[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.first, self.last = np.searchsorted(starts, lo), np.searchsorted(starts, lo + sizes)
        self.doc = np.repeat(np.arange(len(texts)), self.last - self.first)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the n-word windows inside one text, and their hashes."""
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1]) if len(self.doc) >= n else np.zeros(0, np.int64)
        return at, window_hash(self.hashes, at, n)


def window_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    value = np.full(len(at), np.uint64(n), np.uint64)
    for k in range(n):
        value = value * BASE + hashes[at + k]
    return mix(value)


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-word shingles, ordered by both;
    a text of fewer words has its whole sequence as one."""
    at, value = words.windows(n)
    docs, values = [words.doc[at]], [value]
    count = words.last - words.first
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        docs.append(short)
        values.append(window_hash(words.hashes, words.first[short], k))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[fresh], value[fresh]

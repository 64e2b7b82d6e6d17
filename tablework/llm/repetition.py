"""Quality rules: repetition coverage from rolling hashes.

Each task takes slices of texts, numbers their words, and measures with numpy
which characters lie inside n-grams (several lengths) and lines that repeat
an earlier one of the same text.  No shuffle, one pass, whole texts.

Base columns (exact): ``word_chars`` code points in words, ``n_symbols``
characters of ``[#*$%&|<>]``, ``n_dup_lines`` lines with a word equal to an
earlier line, ``n_repeat_words`` words in three-word windows that occur twice
or more.  ``base_failed``: fewer than 50 words, or more than half of the words
repeated that way.

Verdict of the method (``kept``): the base passes, and neither the duplicate
lines nor the duplicate n-grams of any length cover more than their limit of
the characters (the limits are the published MassiveText ones, see
``LINE_LIMIT``, ``LINE_CHAR_LIMIT``, ``NGRAM_LIMITS``).

Edge cases: a null or empty text has no words, all counts 0, and fails the
base rule; a text of one word has no n-grams; repeated rows are judged one by
one; a null ``doc_id`` is passed through; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from tablework.llm.common import SPACES, id_and_text, map_texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Share of lines, and of their characters, that may be duplicates (fixed values).
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
#: Words in an n-gram: share of the characters that duplicated ones may cover (fixed values).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_line_share double, dup_line_char_share double, dup_ngram_char_share array<double>, kept boolean"
)

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _sums(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[hi] - total[lo]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur earlier in ``keys`` as well."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][ranked[1:] == ranked[:-1]]] = True
    return flags


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words 0..size-1 that lie in an n-gram starting at one of ``starts``."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def _windows(doc: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n-word windows that stay inside one document."""
    if len(doc) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])


def _exact_windows(ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of n-word windows and a number for each (document, words): equal
    numbers mean equal words, without hashing."""
    at = _windows(doc, n)
    key = doc[at].astype(np.uint64)
    for k in range(n):
        _, key = np.unique((key << np.uint64(32)) | ids[at + k].astype(np.uint64), return_inverse=True)
        key = key.astype(np.uint64)
    return at, key


def _rolling(ids: np.ndarray, n: int, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Polynomial rolling hash (mod 2^64) of the n words from each start."""
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        value = value * _BASE + (ids[at + k] + np.uint64(1))
    value ^= value >> np.uint64(29)
    return (value * _MIX) ^ ((doc[at].astype(np.uint64) + np.uint64(1)) * _BASE)


def _lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word; of these, repeats of an earlier one; and their bytes."""
    counts = Counter(x for x in text.split(b"\n") if x.strip(SPACES))
    lines = sum(counts.values())
    return lines, lines - len(counts), sum(len(x) * c for x, c in counts.items()), sum(len(x) * (c - 1) for x, c in counts.items())


def measure(doc_ids: list, texts: list[bytes]) -> dict[str, object]:
    """All columns of ``SCHEMA`` for a slice of texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    lo = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    hi = lo + sizes
    space = _IS_SPACE[data]
    leads = (data & 0xC0) != 0x80  # first byte of a code point
    edges = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edges == -1)
    ends = np.flatnonzero(edges == 1)
    first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    n_words = last - first
    doc = np.repeat(np.arange(len(texts)), n_words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for t in texts for w in t.split()), np.uint64, len(starts))
    word_chars = _sums(leads & ~space, lo, hi)
    chars = _sums(leads, starts, ends)

    at, key = _exact_windows(ids, doc, 3)
    repeat = _sums(_covered(at[_twice(key)], 3, len(ids)), first, last)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat > 50 * n_words)

    shares = []
    for n in NGRAM_LIMITS:
        at = _windows(doc, n)
        inside = _covered(at[_again(_rolling(ids, n, at, doc))], n, len(ids))
        shares.append(_sums(np.where(inside, chars, 0), first, last) / np.maximum(word_chars, 1))
    grams = np.array(shares).T if texts else np.zeros((0, len(NGRAM_LIMITS)))
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 4)
    line_share = lines[:, 1] / np.maximum(lines[:, 0], 1)
    line_chars = lines[:, 3] / np.maximum(lines[:, 2], 1)
    bad = (line_share > LINE_LIMIT) | (line_chars > LINE_CHAR_LIMIT) | (grams > np.array(list(NGRAM_LIMITS.values()))).any(axis=1)
    return {
        "doc_id": doc_ids, "n_words": n_words, "word_chars": word_chars, "n_symbols": _sums(_IS_SYMBOL[data], lo, hi),
        "n_dup_lines": lines[:, 1], "n_repeat_words": repeat, "base_failed": base_failed, "dup_line_share": line_share,
        "dup_line_char_share": line_chars, "dup_ngram_char_share": list(grams), "kept": ~base_failed & ~bad,
    }


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the counts, shares and verdict above."""
    return map_texts(id_and_text(docs, id_col, text_col), measure, SCHEMA)

"""Language identification: averaged hashed subword embeddings, linear softmax.

Features: the letter runs of the lower-cased text, each between two border
marks; every run of 1 to ``LONGEST`` code points inside such a word and every
whole word is hashed into one of ``BUCKETS`` buckets.  A text is the average of
its buckets' embeddings (``DIMENSION`` numbers each); a linear layer and a
softmax turn it into probabilities.

Fit (``fit``): labelled rows are taken in turn from every language by the
smallest hashes of id and text, ``MAX_EXAMPLES`` at most; tasks turn their
whole texts into bucket counts of ``BUCKETS`` entries at most, and stochastic
gradient descent in numpy trains embeddings and layer together.  One of
``CHECK_EVERY`` examples is kept out of the training: on these a temperature is
fitted that calibrates the probabilities, and the rejection limit is the lowest
confidence above which at most ``ERROR_RATE`` of them are wrong.

Predict (``predict``): embeddings and layer are multiplied out into one number
per bucket and language (``BUCKETS`` x languages, broadcast), so a text needs
one pass over its features and no shuffle.

Results per row: ``lang_pred`` (a learned value; ``und`` for a text without a
letter), ``score`` (calibrated probability, 0.0 for ``und``) and ``rejected``
(below the limit: not confident enough to be used).

Edge cases: a null or empty text, or one without letters, is ``und``, rejected;
null languages are not learned from; texts without letters are not either;
repeated rows count once in the sample (equal id and text) and are predicted
one by one; a null id is learned from and predicted like any other, not held
out; without any labelled row all texts are ``und``; with one language it is
predicted with score 1.0.  If there are more languages than ``MAX_EXAMPLES``,
those with the largest hashes are not learned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import crc32_text, id_and_text, map_texts, materialise

MAX_EXAMPLES = 3000
BUCKETS, DIMENSION, LONGEST = 1 << 15, 16, 4
EPOCHS, BATCH, RATE = 6, 32, 0.5
CHECK_EVERY, ERROR_RATE = 8, 0.01
FOLDS, HELD_OUT_FOLD = 4, 2
UNKNOWN = "und"

SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"

_LETTERS = regex.compile(r"\p{L}+")
_MARK = "\x02"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def held_out(doc_id):
    """Rows whose language is never learned from."""
    return F.coalesce(F.pmod(crc32_text(doc_id), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))


def _bucket(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(29))) * _MIX
    return ((value ^ (value >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _features(words: list[str]) -> np.ndarray:
    """The buckets of some words, one per occurrence of a feature."""
    codes = np.frombuffer((_MARK + (_MARK + _MARK).join(words) + _MARK).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) for w in words], np.int64) + 2
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    left = np.repeat(start + size, size) - np.arange(len(codes))  # code points to the word's end
    value, out = np.zeros(len(codes), np.uint64), []
    for n in range(1, LONGEST + 1):
        value = value[: max(len(codes) - n + 1, 0)] * _FACTOR + codes[n - 1 :]
        out.append(_bucket(value[left[: len(value)] >= n] + np.uint64(n)))
    weight = codes * _powers(int(size.max()))[np.arange(len(codes)) - np.repeat(start, size)]
    out.append(_bucket(np.add.reduceat(weight, start)))
    return np.concatenate(out)


def histogram(text: str, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text; about ``piece`` code points of it are
    turned into features at a time, so memory does not grow with the text."""
    total, words, size = np.zeros(BUCKETS, np.int64), [], 0
    for match in _LETTERS.finditer(text.lower()):
        words.append(match.group())
        size += len(words[-1])
        if size >= piece:
            total += np.bincount(_features(words), minlength=BUCKETS)
            words, size = [], 0
    if words:
        total += np.bincount(_features(words), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTOR, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Model:
    """``table``: calibrated logits of each bucket; a text's are their average."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: float = 1.0

    def predict(self, text: str) -> tuple[str, float, bool]:
        at, n = histogram(text) if self.langs else ((), ())
        if not len(at):
            return UNKNOWN, 0.0, True
        p = softmax((n / n.sum()) @ self.table[at] + self.bias)
        best = int(p.argmax())
        return self.langs[best], float(min(p[best], 1.0)), bool(p[best] < self.limit)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, n) in enumerate(rows):
        out[i, at] = n / n.sum()
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_langs: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent: (embeddings, layer, bias).

    ``rows``: buckets and counts of each example.  Languages are weighted so
    that each has the same part in the loss."""
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIMENSION, n_langs)).astype(np.float32), np.zeros(n_langs, np.float32)
    share = np.bincount(labels, minlength=n_langs)
    weight = (len(labels) / n_langs / np.maximum(share, 1)).astype(np.float32)
    steps, step = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            take = order[lo : lo + BATCH]
            used = np.unique(np.concatenate([rows[i][0] for i in take]))
            x = np.zeros((len(take), len(used)), np.float32)
            for i, r in enumerate(take):
                at, n = rows[r]
                x[i, np.searchsorted(used, at)] = n / n.sum()
            hidden = x @ embeddings[used]
            grad = softmax(hidden @ layer + bias)
            grad[np.arange(len(take)), labels[take]] -= 1
            grad *= weight[labels[take], None] / len(take)
            rate = np.float32(RATE * (1 - step / steps))
            back = grad @ layer.T
            layer -= rate * (hidden.T @ grad)
            bias -= rate * grad.sum(axis=0)
            # each embedding moves as far as a row of its own would: averages spread a gradient over all features
            scale = np.maximum((x * x).sum(axis=0), 1e-6)
            embeddings[used] -= rate * (x.T @ back) / np.sqrt(scale)[:, None]
            step += 1
    return embeddings, layer, bias


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(temperature, rejection limit) from examples that were not trained on."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20.0), 120))
    # one pseudo-example of even odds keeps a perfectly separated sample from an endless temperature
    loss = [-(np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).sum() + np.log(np.maximum(softmax(logits / t).min(), 1e-12)) / len(labels)) for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(logits / t)
    sure, wrong = p.max(axis=1), p.argmax(axis=1) != labels
    order = np.argsort(-sure, kind="stable")
    errors = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(errors <= ERROR_RATE)
    return t, float(sure[order[good[-1]]]) if len(good) else 1.0


def _examples(docs: DataFrame, limit: int) -> DataFrame:
    """(lang, text) of at most ``limit`` labelled rows, in turn from every language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    hashed = known.withColumn("h", F.xxhash64("doc_id", "text"))
    turn = Window.partitionBy("lang").orderBy("h")
    ranked = hashed.select("lang", "h").distinct().withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= limit)
    chosen = ranked.orderBy("turn", "h", "lang").limit(limit).select("lang", "h")
    return hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("h", "lang", "text")


def fit(docs: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Learn from ``text`` and ``lang`` of the rows that are not held out."""

    def count(ids: list, texts: list[bytes]) -> dict[str, object]:
        found = [histogram(t.decode()) for t in texts]
        return {"h": ids, "at": [at for at, _ in found], "n": [n for _, n in found]}

    sample = materialise(_examples(docs, max_examples), "language-examples")
    counted = map_texts(sample.repartition("h"), count, "h long, at array<int>, n array<int>", id_col="h")
    found = {r.h: (np.array(r.at), np.array(r.n, np.float32)) for r in counted.toLocalIterator()}
    labelled = sorted((r.h, r.lang) for r in sample.select("h", "lang").collect())
    labelled = [x for x in labelled if len(found[x[0]][0])]
    langs = sorted({lang for _, lang in labelled})
    if not langs:
        return Model()
    number = {lang: i for i, lang in enumerate(langs)}
    labels = np.array([number[lang] for _, lang in labelled])
    rows = [found[h] for h, _ in labelled]
    checked = np.arange(len(rows)) % CHECK_EVERY == CHECK_EVERY - 1
    embeddings, layer, bias = train([r for r, c in zip(rows, checked, strict=True) if not c], labels[~checked], len(langs))
    temperature, limit = 1.0, 1.0
    if checked.any():
        held = [r for r, c in zip(rows, checked, strict=True) if c]
        logits = np.concatenate([_dense(held[i : i + 64]) @ embeddings @ layer + bias for i in range(0, len(held), 64)])
        temperature, limit = calibrate(logits, labels[checked])
    return Model(langs, (embeddings @ layer / temperature).astype(np.float32), bias / temperature, limit)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, texts: list[bytes]) -> dict[str, object]:
        out = [shared.value.predict(t.decode()) for t in texts]
        return {"doc_id": ids, "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "rejected": [x[2] for x in out]}

    return map_texts(id_and_text(docs, id_col, text_col), run, SCHEMA)

"""Toxicity: nearest labelled examples by exact TF-IDF cosine.

Fit (``fit``), from at most ``MAX_EXAMPLES`` labelled rows and ``SAMPLE_BYTES``
of their text (smallest hashes of ``doc_id``, so the sample is repeatable; one
row for each id):

* terms are all words of the examples, and the word beginnings of ``STEMS``
  letters whose document counts differ between the labels beyond chance
  (likelihood ratio above a Bonferroni limit);
* document frequencies for the IDF weights are counted over all documents;
* a term's weight is its IDF, times ``UNTOLD`` for words whose counts tell
  nothing about the label by that test: they count, but less;
* the labelled rows become unit TF-IDF vectors, kept by example and in an
  inverted index, where the ``DENSE`` terms of most examples are rows of a
  matrix instead of postings.

Score (``score``): a document's vector has all its words; those of no example
count in its length, with the IDF of a word never seen.  ``TOGETHER`` vectors
at a time meet the matrix (one product) and the postings of their other terms,
in single precision.  Examples that may be among the ``NEIGHBOURS`` best by the
error bound of that arithmetic are met again in double precision, so the
neighbours are exact.  Their labels vote with their similarity; a
logistic curve fitted to leave-one-out votes of the examples turns votes into
probabilities.  The nearest examples are returned as evidence.  One pass
without a shuffle; the index is bounded by the two parameters above.  It goes
to the executors as a file (``ship``) that their Python workers map, so that
they share its pages and hold the terms' numbers only.

Edge cases: null or empty texts, and texts that share no term with an example,
have no neighbours and get the share of toxic examples that have none either;
without usable labels, or with one label only, the score is 0.0 for all.  Of
labels that contradict each other for one id the larger counts; null labels are
left out.  Of different texts with one id the one with the smallest hash is the
example.  Repeated rows are scored one by one.  Labels, language, source and id
are never terms.
"""

from __future__ import annotations

import atexit
import math
import os
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablework.llm.common import chunks, crc32_text, id_and_text, map_texts, release_memory

MAX_EXAMPLES = 4096
SAMPLE_BYTES = 32 << 20
STEMS = (4, 5, 6)
MIN_DOCS = 3
FALSE_FEATURES = 0.05
UNTOLD = 0.1
DENSE = 512
TOGETHER = 32
NEIGHBOURS = 15
PRIOR_WEIGHT = 0.25
N_EVIDENCE = 3
HOLD_OUT = 5

SCHEMA = "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"

_WORD = re.compile(r"[^\W\d_]+")


#: Of Latin-1: letters stay, what ends a word becomes a space.
_LATIN = bytes(c if _WORD.fullmatch(chr(c)) else 32 for c in range(256))


def words(raw: bytes) -> list[str]:
    text = raw.decode("utf-8", "replace").lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def features(word: str) -> list[str]:
    """The word itself and its beginnings (``abcd~``)."""
    return [word] + [word[:n] + "~" for n in STEMS if len(word) >= n]


class TermCounter:
    """Counts of a text's terms (by number), and of its words that are none."""

    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.heads = {t[: STEMS[0]] for t in terms if t.endswith("~")}

    def _begun(self, distinct: Iterable[str]) -> Iterator[tuple[str, int]]:
        """The words with beginnings that are terms, once for each of these."""
        heads, n, get = self.heads, STEMS[0], self.index.get
        for w in distinct:
            if w[:n] in heads:
                for f in features(w)[1:]:
                    if (i := get(f)) is not None:
                        yield w, i

    def __call__(self, raw: bytes) -> tuple[dict[int, int], list[int]]:
        counts = Counter(words(raw))
        numbers = list(map(self.index.get, counts))
        found = dict(zip(numbers, counts.values(), strict=True))
        unknown: list[int] = []
        if None in found:  # its place holds the last of the unknown words only
            del found[None]
            unknown = [n for i, n in zip(numbers, counts.values(), strict=True) if i is None]
        for w, i in self._begun(counts):
            found[i] = found.get(i, 0) + counts[w]
        return found, unknown

    def present(self, raw: bytes) -> list[int]:
        """The numbers of the terms in a text."""
        distinct = set(words(raw))
        found = set(map(self.index.get, distinct))
        found.update(i for _, i in self._begun(distinct))
        found.discard(None)
        return list(found)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges in turn, and their lengths."""
    n = stop - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


Vector = tuple[np.ndarray, np.ndarray]  # terms, rising, and their values


@dataclass
class Index:
    """Unit vectors by example, and inverted: the terms of most examples as rows
    of a matrix, the others with their postings."""

    idf: np.ndarray  # weights of the terms
    ids: np.ndarray  # of the examples, in index order
    toxic: np.ndarray
    first: np.ndarray  # place of each example's first term
    term: np.ndarray
    weight: np.ndarray
    row: np.ndarray  # of each term in the matrix, -1 if it has none
    first_posting: np.ndarray  # of each term
    example: np.ndarray  # of each posting
    rough: np.ndarray  # its weight in single precision
    _rows: np.ndarray | None = field(default=None, repr=False)
    _query: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def build(cls, vectors: list[dict[int, int]], ids: list, toxic: list[int], idf: np.ndarray) -> Index:
        return cls.of([_arrays(v, float) for v in vectors], ids, toxic, idf)

    @classmethod
    def of(cls, vectors: list[Vector], ids: list, toxic: list[int], idf: np.ndarray) -> Index:
        units = [_unit(*v, idf) for v in vectors]
        # the order decides between examples of equal similarity: by their heaviest terms, then by id
        order = sorted(range(len(units)), key=lambda i: (units[i][0][np.argsort(-units[i][1], kind="stable")[:16]].tolist(), ids[i]))
        lengths = np.array([len(units[i][0]) for i in order], np.int64)
        term = np.concatenate([units[i][0] for i in order] or [np.zeros(0)]).astype(np.int32)
        weight = np.concatenate([units[i][1] for i in order] or [np.zeros(0)])
        held = np.bincount(term, minlength=len(idf))
        dense = np.sort(np.argsort(-held, kind="stable")[:DENSE])
        row = np.full(len(idf), -1, np.int32)
        row[dense] = np.arange(len(dense))
        posting = np.argsort(term, kind="stable")
        posting = posting[row[term[posting]] < 0]
        example = np.repeat(np.arange(len(order), dtype=np.int32), lengths)[posting]
        return cls(
            idf, np.array([ids[i] for i in order], np.int64), np.array([toxic[i] for i in order], np.int64), np.append(0, np.cumsum(lengths)),
            term, weight, row, np.searchsorted(term[posting], np.arange(len(idf) + 1)), example, weight[posting].astype(np.float32),
        )

    def matrix(self) -> np.ndarray:
        """Weights in all examples of the terms that have a row."""
        if self._rows is None:
            at = np.flatnonzero(self.row[self.term] >= 0)
            self._rows = np.zeros((int(self.row.max(initial=-1)) + 1, len(self.ids)), np.float32)
            self._rows[self.row[self.term[at]], np.searchsorted(self.first, at, "right") - 1] = self.weight[at]
        return self._rows

    def nearest(self, query: dict[int, float], k: int = NEIGHBOURS, skip: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of largest cosine above 0 as (similarity, example
        number); equal ones by example number."""
        return self.nearest_to([_arrays(query, float)], k, [skip])[0]

    def nearest_to(self, queries: Sequence[Vector], k: int = NEIGHBOURS, skip: Sequence[int] = ()) -> list[list[tuple[float, int]]]:
        """:meth:`nearest` of each vector."""
        found = []
        for i in range(0, len(queries), TOGETHER):
            part = queries[i : i + TOGETHER]
            scores = self._rough(part)
            for at, without in enumerate(skip[i : i + TOGETHER]):
                if without >= 0:
                    scores[at, without] = 0
            found += [self._exact(*q, s, k) for q, s in zip(part, scores, strict=True)]
        return found

    def _rough(self, queries: Sequence[Vector]) -> np.ndarray:
        """Similarities to all examples, in single precision."""
        n, rows = len(self.ids), self.matrix()
        heavy = np.zeros((len(queries), len(rows)), np.float32)
        scores = np.empty((len(queries), n), np.float32)
        for q, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            heavy[q, row[row >= 0]] = weights[row >= 0]
            rest, weights = terms[row < 0], weights[row < 0]
            at, lengths = _ranges(self.first_posting[rest], self.first_posting[rest + 1])
            scores[q] = np.bincount(self.example[at], np.repeat(weights, lengths) * self.rough[at], n)
        scores += heavy @ rows
        return scores

    def _exact(self, terms: np.ndarray, weights: np.ndarray, rough: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The nearest examples, given similarities of single precision.  These
        are sums over the matrix's terms of products that add up to 1 at most,
        so each is off by a rounding error a term and a few more at most."""
        error = (len(self.matrix()) + 16) * 2.0**-24
        found = np.flatnonzero(rough > (max(0.0, np.partition(rough, -k)[-k] - 3 * error) if len(rough) > k else 0))
        if self._query is None:
            self._query = np.zeros(len(self.idf))
        self._query[terms] = weights
        begin, end = self.first[found], self.first[found + 1]
        held = [slice(i, j) for i, j in zip(begin.tolist(), end.tolist(), strict=True)] or [slice(0)]
        products = self._query[np.concatenate([self.term[x] for x in held])] * np.concatenate([self.weight[x] for x in held])
        scores = np.round(np.bincount(np.repeat(np.arange(len(found)), end - begin), products, len(found)), 12)
        self._query[terms] = 0
        order = np.lexsort((found, -scores))[:k]
        return list(zip(scores[order].tolist(), found[order].tolist(), strict=True))


def _arrays(by_term: dict, kind: type) -> Vector:
    """The terms of a vector, rising, and their values."""
    terms, values = np.fromiter(by_term, np.int64, len(by_term)), np.fromiter(by_term.values(), kind, len(by_term))
    order = np.argsort(terms)
    return terms[order], values[order]


def _unit(terms: np.ndarray, values: np.ndarray, idf: np.ndarray, unknown: Sequence[int] = (), unseen: float = 0.0) -> Vector:
    """The TF-IDF vector of a text over its length; words that are no terms
    (their counts in ``unknown``) only make it longer."""
    weights = (1 + np.log(values)) * idf[terms]
    other = (1 + np.log(np.sort(np.array(unknown, float)))) * unseen
    return terms, weights / math.sqrt(float((weights * weights).sum() + (other * other).sum()))


def unit(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    terms, weights = _unit(*_arrays(counts, float), idf)
    return dict(zip(terms.tolist(), weights.tolist(), strict=True))


@dataclass
class Model:
    terms: list[str]
    index: Index | None = None
    prior: float = 0.0
    none_rate: float = 0.0  # toxic share of examples without a neighbour
    unseen: float = 0.0  # weight of a word that no example has
    curve: tuple[float, float] = (1.0, 0.0)
    _counter: TermCounter | None = field(default=None, repr=False)

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near or self.index is None:
            return self.none_rate
        weight = sum(s for s, _ in near)
        toxic = sum(s for s, i in near if self.index.toxic[i])
        return (toxic + PRIOR_WEIGHT * self.prior) / (weight + PRIOR_WEIGHT)

    def score(self, raw: bytes) -> tuple[float, list[tuple[float, int]]]:
        return next(self.scores([raw]))

    def scores(self, texts: list[bytes]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Score and nearest examples of each text."""
        if self.index is None:
            yield from ((0.0, []) for _ in texts)
            return
        if self._counter is None:
            self._counter = TermCounter(self.terms)
        for i in range(0, len(texts), TOGETHER):
            counted = [self._counter(t) for t in texts[i : i + TOGETHER]]
            near = iter(self.index.nearest_to([_unit(*_arrays(c, float), self.index.idf, unknown, self.unseen) for c, unknown in counted if c]))
            for c, _ in counted:
                found = next(near) if c else []
                yield calibrated(self.vote(found), self.curve), found


#: The arrays of an index that a file holds.
ARRAYS = ("idf", "ids", "toxic", "first", "term", "weight", "row", "first_posting", "example", "rough", "_rows")


@dataclass
class Shipped:
    """A model whose terms and arrays stand in a file that executors have.  A
    task's function that holds this is small; what it opens is mapped, so the
    Python workers of an executor share the pages."""

    name: str
    places: dict[str, tuple[str, tuple[int, ...], int, int]]  # of each array: type, shape, first byte, end
    numbers: dict[str, object]  # the model's other fields

    def open(self) -> Model:
        if not self.places:
            return Model([], **self.numbers)
        data = np.asarray(np.memmap(SparkFiles.get(self.name), np.uint8, "r"))
        found = {k: data[i:j].view(kind).reshape(shape) for k, (kind, shape, i, j) in self.places.items()}
        terms = found.pop("terms").tobytes().decode().split("\n")
        return Model(terms, Index(**found), **self.numbers)


def ship(spark: SparkSession, model: Model) -> Shipped:
    """Write the model to a file of the driver, which Spark copies to each
    executor once; it is kept as long as the driver runs."""
    numbers = {"prior": model.prior, "none_rate": model.none_rate, "unseen": model.unseen, "curve": model.curve}
    if model.index is None:
        return Shipped("", {}, numbers)
    model.index.matrix()
    arrays = {k: getattr(model.index, k) for k in ARRAYS} | {"terms": np.frombuffer("\n".join(model.terms).encode(), np.uint8)}
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tablework-model-"))
    atexit.register(shutil.rmtree, folder, True)
    name, places = f"toxicity-{uuid.uuid4().hex}", {}
    with open(f"{folder}/{name}", "wb") as f:
        for k, a in arrays.items():
            f.write(b"\0" * (-f.tell() % 64))
            places[k] = (a.dtype.str, a.shape, f.tell(), f.tell() + a.nbytes)
            f.write(np.ascontiguousarray(a).data)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return Shipped(name, places, numbers)


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def calibrated(vote: float, curve: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-(curve[0] * logit(vote) + curve[1])))


def fit_curve(votes: list[float], toxic: list[int], pull: float = 1.0) -> tuple[float, float]:
    """Logistic regression of the label on the vote's log-odds, pulled towards
    the identity (``a`` = 1, ``b`` = 0) so that separable votes stay finite."""
    x, y = np.array([logit(v) for v in votes]), np.array(toxic, float)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        grad = np.array([((p - y) * x).sum() + pull * (a - 1), (p - y).sum() + pull * b])
        w = p * (1 - p)
        hess = np.array([[(w * x * x).sum() + pull, (w * x).sum()], [(w * x).sum(), w.sum() + pull]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(crc32_text(doc_id), F.lit(HOLD_OUT)) == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, limit: int, text_bytes: int) -> DataFrame:
    """(doc_id, text, toxic): one row for each of at most ``limit`` ids, with
    ``text_bytes`` of text in all."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # of several texts of an id one is chosen by its hash, so that only chosen texts move
    sized = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).alias("t"))
    one = sized.groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))  # `limit` rows at most
    along = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = one.withColumn("sum", F.sum("t.n").over(along)).where(F.col("sum") <= text_bytes).select("doc_id", "toxic", F.col("t.h").alias("h"))
    return docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(fitting), ["doc_id", "h"]).dropDuplicates(["doc_id"]).drop("h")


def _terms(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """All words of the examples and the telling beginnings, sorted, and which
    of them tell about the label; no terms unless both labels are there."""
    def distinct(ids: list, texts: list[bytes]) -> dict[str, object]:
        return {"doc_id": ids, "fs": [sorted({f for w in set(words(t)) for f in features(w)}) for t in texts]}

    per_doc = map_texts(sample, distinct, "doc_id long, fs array<string>")
    labelled = per_doc.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id")
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not n_toxic or n_toxic == n:
        return [], np.zeros(0, bool)
    counts = labelled.select("toxic", F.explode("fs").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = counts.persist()
    try:
        # chance that a feature unrelated to the label gets this far, times their number
        tried = max(counts.where(F.col("a") + F.col("b") >= MIN_DOCS).count(), 1)

        def part(seen, expected):
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        a, b, t, c = F.col("a"), F.col("b"), F.lit(float(n_toxic)), F.lit(float(n - n_toxic))
        d = a + b
        ratio = 2 * (part(a, d * t / n) + part(b, d * c / n) + part(t - a, (n - d) * t / n) + part(c - b, (n - d) * c / n))
        tells = (d >= MIN_DOCS) & (ratio >= 2 * math.log(tried / FALSE_FEATURES))
        rows = counts.select("f", tells.alias("tells")).where(~F.col("f").endswith("~") | F.col("tells")).toArrow()  # words of the sample
    finally:
        counts.unpersist()
    found = dict(zip(rows.column("f").to_pylist(), rows.column("tells").to_pylist(), strict=True))
    terms = sorted(found)
    return terms, np.array([found[f] for f in terms], bool)


def _document_frequencies(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """Documents that hold each term, over all documents; a task sends one row
    per term at most."""
    import pyarrow as pa

    joined, n = "\n".join(terms), len(terms)  # one string takes less of a worker than many

    def run(batches):
        count, total = TermCounter(joined.split("\n")), np.zeros(n, np.int64)
        for _, texts in chunks(batches):
            for t in texts:
                total[count.present(t)] += 1
        del count
        release_memory()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms))
    out[np.asarray(rows.column("i"))] = np.asarray(rows.column("n"))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of the rows not held out."""
    source = id_and_text(docs)
    sample = _sample(source, labels, max_examples, sample_bytes).persist()
    try:
        terms, tells = _terms(sample)
        if not terms:
            return Model([])

        def vectors(ids: list, texts: list[bytes]) -> dict[str, object]:
            count = TermCounter(terms)
            found = [sorted(count(t)[0].items()) for t in texts]
            return {"doc_id": ids, "f": [[i for i, _ in x] for x in found], "n": [[c for _, c in x] for x in found]}

        found = map_texts(sample, vectors, "doc_id long, f array<int>, n array<int>").join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").toArrow()
    finally:
        sample.unpersist()
    found = found.sort_by("doc_id").combine_chunks()
    ids, toxic = found.column("doc_id").to_pylist(), found.column("toxic").to_pylist()
    numbers, counts = (found.column(c).combine_chunks() for c in "fn")
    bounds = np.append(0, np.cumsum(np.asarray(numbers.value_lengths())))
    numbers, counts = np.asarray(numbers.flatten()), np.asarray(counts.flatten()).astype(float)
    told = np.where(tells, 1.0, UNTOLD)
    n_docs = source.count()
    idf = told * (np.log((1 + n_docs) / (1 + _document_frequencies(source, terms))) + 1)
    inside = [i for i in range(len(ids)) if bounds[i] < bounds[i + 1]]
    outside = [toxic[i] for i in range(len(ids)) if bounds[i] == bounds[i + 1]]
    vectors = [(numbers[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]]) for i in inside]
    prior = sum(toxic) / len(toxic)
    index = Index.of(vectors, [ids[i] for i in inside], [toxic[i] for i in inside], idf)
    model = Model(terms, index, prior, (sum(outside) + prior) / (len(outside) + 1), UNTOLD * (math.log(1 + n_docs) + 1))
    number = {int(i): at for at, i in enumerate(index.ids)}
    near = index.nearest_to([_unit(*v, idf) for v in vectors], skip=[number[ids[i]] for i in inside])
    votes = [model.vote(x) for x in near]
    model.curve = fit_curve(votes + [model.none_rate] * len(outside), [toxic[i] for i in inside] + outside)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: score, predicted label, nearest examples."""
    shipped = ship(docs.sparkSession, model)
    opened: list[Model] = []  # of a task

    def run(ids: list, texts: list[bytes]) -> dict[str, object]:
        if not opened:
            opened.append(shipped.open())
        results, index = list(opened[0].scores(texts)), opened[0].index
        evidence = [[{"doc_id": int(index.ids[i]), "similarity": s, "toxic": int(index.toxic[i])} for s, i in near[:N_EVIDENCE]] for _, near in results]
        return {"doc_id": ids, "score": [s for s, _ in results], "predicted": [int(s >= 0.5) for s, _ in results], "evidence": evidence}

    return map_texts(id_and_text(docs, id_col, text_col), run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not predicted toxic."""
    import pyarrow as pa

    shipped = ship(docs.sparkSession, model)

    def run(batches):
        model = shipped.open()
        for part, texts in chunks(batches):
            yield part.filter(pa.array([s < 0.5 for s, _ in model.scores(texts)], pa.bool_()))
        del model
        release_memory()

    return docs.mapInArrow(run, docs.schema)

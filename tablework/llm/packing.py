"""Packing by cutting-stock column generation.

1. ``pieces``: one pass tokenises every document and cuts it into pieces of at
   most ``capacity`` ids: whole ones from the start, then the rest.
2. The piece lengths, rounded up to ``capacity / BINS``, give a histogram of at
   most ``BINS`` counts.  On the driver, ``cutting_stock`` solves the linear
   program over patterns (how many pieces of each length share a sequence) by
   column generation: a knapsack dynamic programme prices the columns.  Counts
   are rounded down; what is left over, a few pieces per pattern, is filled
   sequence by sequence with the subset that fits best.
3. Pieces are ranked within their length and matched with the patterns' slots:
   the k-th piece of a length has its sequence by arithmetic on k.  Ranks come
   from hash buckets (count per bucket, running sum, row number), so a length
   that a third of all pieces share is spread over all buckets.

Only the histogram goes to the driver and only the pattern table (a few
thousand numbers) to the executors, at any size of input.

Edge cases: null and empty texts are documents of the end id alone; a text of
exactly the capacity (with the end id) is one piece; repeated rows are packed
one by one; null ids are passed through; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import id_and_text, map_texts, materialise, release_memory

CAPACITY = 2048
BINS = 256
END_ID = 1
CACHED_WORDS = 800_000
SLICE_BYTES = 4 << 20
GAP = 1e-4  # of the linear programme's bound
SMOOTHING = 0.8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class WordEncoder:
    """Ids of a text as little-endian 32-bit integers.

    White space never reaches this tokenizer's merges, so a text's ids are its
    words' ids in order, and each word is encoded once as long as it is in the
    cache.  The cache has two generations of at most ``cached`` words (and
    a slice's more); words still in use move to the younger one.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.cached = cached
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = next((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special), None)
        self.mark, self.mark_id = special, special and self.tokenizer.token_to_id(special)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str, marked: bool) -> list[int]:
        self.tokenizer.encode_special_tokens = not marked  # else a special token's text is ordinary text
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: many words are one text with a special token
        between them, at which the ids are cut."""
        if not words:
            return []
        out: list[bytes] = []
        texts = [w.decode("utf-8", "replace") for w in words]
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            # without a special token, or where a word may hold its text: one by one
            odd = [i for i, w in enumerate(part) if self.mark is None or "<|" in w or "|>" in w]
            for i in odd:
                part[i] = "a"
            ids = np.array([] if self.mark is None else self._ids(self.mark.join(part), marked=True), "<u4")
            cut = np.flatnonzero(ids == self.mark_id)
            raw = ids.tobytes()
            found = [raw[4 * i : 4 * j] for i, j in zip([0, *(cut + 1)], [*cut, len(ids)], strict=True)] if self.mark else [b""] * len(part)
            for i in odd:
                found[i] = np.array(self._ids(texts[at + i], marked=False), "<u4").tobytes()
            out += found
        return out

    def _learn(self, new: set[bytes]) -> None:
        if len(self.young) > self.cached:
            self.old, self.young = self.young, {}
            new = self.seen
        young, old, missing = self.young, self.old, []
        for w in new:
            if (ids := old.get(w)) is None:
                missing.append(w)
            else:
                young[w] = ids
        # a full stop or comma after a letter or digit is a word of its own to the tokenizer
        stems = {w: w[:-1] for w in missing if w[-1:] in b".," and len(w) > 1 and w[:-1].decode("utf-8", "replace")[-1].isalnum()}
        todo = {stems.get(w, w) for w in missing}
        todo |= {b".", b","}
        todo = [w for w in todo if w not in young]
        young.update(zip(todo, self._encode(todo), strict=True))
        for w, stem in stems.items():
            young[w] = young[stem] + young[w[-1:]]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() for t in texts]  # bytes: A-Z only; the tokenizer lower-cases the rest
        self.seen = set().union(*split)
        self._learn(self.seen - self.young.keys())
        get = self.young.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def encoder(path: str, keep: bool, cached: int = CACHED_WORDS) -> WordEncoder:
    """An encoder; with ``keep`` the Python worker's, which outlives a task, so
    that the next task finds the tokenizer loaded and its cache warm."""
    import tokenizers

    if not keep:
        release_memory()  # what the worker's earlier tasks left after their end
        own = WordEncoder(path, cached)
        release_memory()  # what reading the tokenizer's file took
        return own

    held = vars(tokenizers).setdefault("_tablework_encoders", {})
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, keep: bool = True, cached: int = CACHED_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Every document's pieces; ``ids`` only where asked for.  ``keep`` leaves
    the word cache in the Python workers after a task (in the ``tokenizers``
    module, which outlives it; two generations of ``CACHED_WORDS`` words at most):
    faster, but the memory is missing in the stages that follow.  Without it a
    task has its own cache of ``cached`` words."""
    end = np.array([END_ID], "<u4").tobytes()
    own: dict[str, WordEncoder] = {}  # a task's
    def run(doc_ids: list, texts: list[bytes]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        encode = own.get("encoder") or own.setdefault("encoder", encoder(tokenizer_path, keep, cached))
        for doc_id, ids in zip(doc_ids, encode(texts), strict=True):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, capacity):
                part = ids[4 * start : 4 * (start + capacity)]
                row = (doc_id, start, len(part) // 4, zlib.crc32(part), n, part if with_ids else None)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return out

    return map_texts(id_and_text(docs), run, PIECES, max_bytes=slice_bytes)


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest value that fits: unbounded knapsack."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        best[room] = best[room - 1]
        if len(fits):
            worth = best[room - sizes[fits]] + values[fits]
            i = int(worth.argmax())
            if worth[i] > best[room] + 1e-12:
                best[room], took[room] = worth[i], fits[i]
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, a few hundred rows (element-wise, so that
    no thread pool is woken in the driver for a small matrix)."""
    n = len(matrix)
    work = np.concatenate((matrix.astype(float), np.eye(n)), axis=1)
    for k in range(n):
        p = k + int(abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns of the linear programme's basis and how often each is used
    (fractions): revised simplex, columns priced by the knapsack.

    Prices are smoothed towards those of the best lower bound so far, which
    needs far fewer columns.  Ends within half a sequence or ``GAP`` of the
    bound, or when no pattern improves.
    """
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / (capacity // sizes))
    used = _times(inverse, demand)
    bound, centre, step = 0.0, None, 0
    least, since = used.sum(), 0
    while since < 20 * m + 500:  # degenerate steps in a row; any basis is a plan
        duals = inverse.sum(axis=0)
        prices = [duals] if centre is None else [SMOOTHING * centre + (1 - SMOOTHING) * duals, duals]
        for price in prices:
            value, pattern = _price(price, sizes, capacity)
            if value > 0 and (price * demand).sum() / value > bound:
                bound, centre = (price * demand).sum() / value, price / value
            if (duals * pattern).sum() > 1 + 1e-9:
                break
        else:
            return columns, used
        if used.sum() - bound < max(0.5, GAP * used.sum()):
            return columns, used
        direction = _times(inverse, pattern)
        up = np.flatnonzero(direction > 1e-9)
        out = int(up[(used[up] / direction[up]).argmin()])
        columns[out] = pattern
        step += 1
        if step % 200 == 0:  # against rounding errors
            inverse = _inverse(np.array(columns).T)
        else:
            row = inverse[out] / direction[out]
            inverse -= direction[:, None] * row
            inverse[out] = row
        used = np.maximum(_times(inverse, demand), 0)
        since = 0 if used.sum() < least * (1 - 1e-12) else since + 1
        least = min(least, used.sum())
    return columns, used


def _fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """One sequence: the largest piece left, then the subset of the others that
    fills most of the rest."""
    pattern = np.zeros(len(sizes), int)
    first = int(np.flatnonzero(left).max())
    pattern[first] = 1
    room = capacity - sizes[first]
    reach = np.full(room + 1, -1)  # the size that last reached this sum
    reach[0] = len(sizes)
    for i in np.flatnonzero(left)[::-1]:
        for _ in range(min(int(left[i]) - pattern[i], room // int(sizes[i]))):
            fresh = np.flatnonzero((reach[: room + 1 - sizes[i]] >= 0) & (reach[sizes[i] :] < 0))
            if not len(fresh):
                break
            reach[fresh + sizes[i]] = i
        if reach[room] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0).max())
    while at > 0:
        i = reach[at]
        pattern[i] += 1
        at -= sizes[i]
    return np.minimum(pattern, left)


def cutting_stock(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces by size, number of sequences) that place every piece once."""
    sizes = np.array(sorted(histogram), int)
    left = np.array([histogram[s] for s in sizes], int)
    plan: list[tuple[dict[int, int], int]] = []

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        plan.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, times))
        left = left - pattern * times

    if not len(sizes):
        return plan
    columns, used = column_generation(sizes, left.astype(float), capacity)
    for pattern, often in sorted(zip(columns, used, strict=True), key=lambda x: -x[1]):
        times = min(int(often + 1e-9), *(int(left[i] // pattern[i]) for i in np.flatnonzero(pattern)))
        if times > 0:
            place(pattern, times)
    while left.any():
        pattern = _fill(sizes, left, capacity)
        place(pattern, int(min(left[i] // pattern[i] for i in np.flatnonzero(pattern))))
    return plan


@dataclass
class Slots:
    """For each size and interval of ranks: the first sequence, pieces of that
    size in each, and the place of the first of them."""

    key: np.ndarray
    first_sequence: np.ndarray
    copies: np.ndarray
    place: np.ndarray

    @classmethod
    def build(cls, plan: list[tuple[dict[int, int], int]]) -> Slots:
        rows, sequence, seen = [], 0, {}
        for pattern, times in plan:
            place = 0
            for size in sorted(pattern, reverse=True):
                rows.append(((size << 44) + seen.get(size, 0), sequence, pattern[size], place))
                seen[size] = seen.get(size, 0) + pattern[size] * times
                place += pattern[size]
            sequence += times
        rows.sort()
        return cls(*np.array(rows, np.int64).reshape(-1, 4).T)

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (size.astype(np.int64) << 44) + rank
        at = np.searchsorted(self.key, key, "right") - 1
        within = key - self.key[at]
        return self.first_sequence[at] + within // self.copies[at], self.place[at] + within % self.copies[at]


def assign(parts: DataFrame, capacity: int = CAPACITY, bins: int = BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``length`` up to
    ``capacity``); other columns stay.  ``parts`` is read several times."""
    import pyarrow as pa

    width = -(-capacity // bins)
    buckets = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = parts.withColumn("size", F.ceil(F.col("length") / F.lit(width)).cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    )
    counts = sized.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # `bins` rows at most
    slots = Slots.build(cutting_stock(histogram, capacity // width))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("size", "bucket").orderBy("length", "doc_id", "start", "ids_crc32")
    ranked = sized.withColumn("at", F.row_number().over(order)).join(before.drop("n"), ["size", "bucket"]).withColumn("rank", F.col("at") - 1 + F.col("before"))
    kept = [c for c in parts.columns if c not in ("sequence_id", "place")]
    schema = ranked.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("place")).schema

    def run(batches):
        for b in batches:
            sequence, place = slots.find(np.asarray(b.column("size")), np.asarray(b.column("rank")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(place)], names=[*kept, "sequence_id", "place"])

    placed = ranked.select(*kept, "size", "rank").mapInArrow(run, schema)
    along = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0))).drop("place")


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, keep: bool = True, cached: int = CACHED_WORDS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids (binary).  The cache's
    settings (see :func:`pieces`) change time and memory only."""
    parts = pieces(docs, tokenizer_path, capacity, with_ids, keep, cached, slice_bytes)
    return assign(materialise(parts if with_ids else parts.drop("ids"), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Padded id arrays (binary, 32-bit little-endian) from ``pack(with_ids=True)``:
    at most ``capacity`` ids a sequence, padded unless their number is a power
    of two."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))).alias("ps"), F.sum("length").alias("n_ids"))
    joined = F.array_join(F.transform("ps", lambda p: p["h"]), "")
    pad = F.when(F.expr("n_ids & (n_ids - 1)") == 0, F.lit(0)).otherwise(F.lit(capacity) - F.col("n_ids"))
    pad_hex = np.array([pad_id], "<u4").tobytes().hex().upper()
    return parts.select("sequence_id", "n_ids", F.unhex(F.concat(joined, F.repeat(F.lit(pad_hex), pad.cast("int")))).alias("ids"))

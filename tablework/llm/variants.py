"""Spelling variant grouping by blocked Gram matrices of letter counts.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased;
a run whose checksum with its document's id is divisible by ``DROP_EVERY`` loses
one code point (the planted misspelling of the contract).  Kept are words of at
least ``MIN_LENGTH`` code points with ``MIN_COUNT`` occurrences or more.

1. Count: every task counts the words of its texts in a bounded dictionary,
   and a shuffle adds the counts up.
2. Blocks: two words one edit apart differ by one in the counts of at most two
   letters.  The letters are dealt into ``PARTS`` parts of about equal use, so
   such words agree on all letters of at least ``PARTS - 2`` parts.  Every
   choice of that many parts is a key, and a word goes to the block of each of
   its keys.  A key of more than ``TILE`` words is cut into parts by a hash of
   the word, and every pair of parts is a block of its own: blocks are bounded,
   and no pair is lost.
3. Gram matrices: in a block, words lie in order of length, and NumPy products
   of the count matrices of equal or adjacent lengths give the squared
   distances.  Only pairs at a distance of exactly 2 (equal length) or 1
   (adjacent lengths) are kept; their spelling is then compared, and a pair is
   reported at the first of its keys only.
4. Every word takes its most frequent near word as its form if that is
   ``RATIO`` times as frequent as itself.  Counts grow along forms, so they are
   a forest; roots come from pointer jumping over the words that have a form.

Pairs leave a task only after the exact comparison.  Counts are exact integers
in float64 products, however long a word is.

Edge cases: null and empty texts hold no words; a null id means that no run of
the text loses a code point; repeated rows count twice; a run of any length is
one word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import ascii_lower_bytes, chunks, join_side, materialise, release_memory

MIN_LENGTH, MIN_COUNT, DROP_EVERY, RATIO = 7, 2, 31, 10
#: Parts that the letters are dealt into; words in one part of a divided key.
PARTS, TILE = 4, 4096
#: Rows of one matrix; distinct words a task holds before it passes them on.
ROWS, HELD = 1024, 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = 26 + 64
COMBOS = list(combinations(range(PARTS), PARTS - 2))


def lower(text: str) -> str:
    return text.lower() if text.isascii() else ascii_lower_bytes(text.encode()).decode()


def spelled(doc_id: int | None, run: str) -> str:
    """``run`` as the document ``doc_id`` spells it."""
    h = zlib.crc32(b"%d:%s" % (doc_id, run.encode())) if doc_id is not None else 1
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def flush(seen: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part, texts in chunks(batches):
            for doc_id, raw in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                for word, n in Counter(_RUN.findall(lower(raw.decode()))).items():
                    if len(word) >= MIN_LENGTH:
                        word = spelled(doc_id, word)
                        if len(word) >= MIN_LENGTH:
                            seen[word] += n
                if len(seen) >= HELD:
                    yield flush(seen)
        yield flush(seen)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted.where(F.col("n") >= MIN_COUNT), "words")


class Letters:
    """The letters of a list of words, one byte each, end to end."""

    def __init__(self, words: pa.Array):
        raw = [w.encode("latin-1") for w in words.to_pylist()]
        self.size = np.array([len(w) for w in raw], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1] if raw else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.number = np.where(self.flat < 128, self.flat.astype(np.int64) - ord("a"), self.flat.astype(np.int64) - 0xC0 + 26)

    def counts(self) -> np.ndarray:
        row = np.repeat(np.arange(len(self.size)), self.size)
        return np.bincount(row * LETTERS + self.number, minlength=len(self.size) * LETTERS).reshape(-1, LETTERS)

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` are one edit apart, for pairs of
        different words of which ``a`` is as long as ``b`` or one shorter."""
        n = self.size[a]
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        t = np.arange(int(n.sum())) - np.repeat(first, n)
        far = np.iinfo(np.int64).max >> 1

        def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.minimum(np.minimum.reduceat(np.where(x == y, far, t), first), n)

        ahead = common(self.flat[np.repeat(self.start[a], n) + t], self.flat[np.repeat(self.start[b], n) + t])
        back = common(self.flat[np.repeat((self.start + self.size)[a], n) - 1 - t], self.flat[np.repeat((self.start + self.size)[b], n) - 1 - t])
        return ahead + back >= self.size[b] - 1


def deal_letters(words: DataFrame) -> np.ndarray:
    """The part of each letter: by falling use, each to the least used part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS, np.int64)
        for batch in batches:
            total += np.bincount(Letters(batch.column("word")).number, minlength=LETTERS)
        yield pa.RecordBatch.from_pydict({"letter": pa.array(range(LETTERS), pa.int32()), "n": pa.array(total, pa.int64())})

    use = np.zeros(LETTERS, np.int64)
    for letter, n in words.select("word").mapInArrow(run, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        use[letter] = n
    part, load = np.zeros(LETTERS, np.int64), [0] * PARTS
    for letter in np.argsort(-use, kind="stable"):
        part[letter] = load.index(min(load))
        load[part[letter]] += int(use[letter])
    return part


def _keys(words: DataFrame, part: np.ndarray) -> DataFrame:
    """(combo, key, size, word, n): every word under each of its keys."""
    factor = np.random.default_rng(11).integers(1, 1 << 62, LETTERS).astype(np.uint64) | np.uint64(1)
    inside = np.array([[part[x] in c for c in COMBOS] for x in range(LETTERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column("word"))
            counts = letters.counts().astype(np.uint64)
            for c in range(len(COMBOS)):
                x = counts @ np.where(inside[:, c], factor, np.uint64(0))  # modulo 2^64; equal counts give equal keys
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array((x ^ (x >> np.uint64(29))).astype(np.int64)), pa.array(letters.size), batch.column("word"), batch.column("n")],
                    ["combo", "key", "size", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "combo int, key long, size long, word string, n long")


def _blocks(keyed: DataFrame, tile: int) -> DataFrame:
    """Adds ``block`` and ``side`` (0 both, 1 left, 2 right) to the keyed words:
    keys of more than ``tile`` words become all pairs of their parts."""
    large = keyed.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > tile)
    cut = large.select(F.col("combo").alias("c"), F.col("key").alias("k"), F.ceil(F.col("m") / tile).cast("int").alias("parts"))
    joined = join_side(keyed.withColumns({"c": F.col("combo"), "k": F.col("key")}), cut, ["c", "k"], "left").drop("c", "k")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(
            (F.least(q, own) * F.col("parts") + F.greatest(q, own)).alias("block"),
            F.when(q == own, 0).when(own < q, 1).otherwise(2).alias("side"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("side")))
    return joined.select("combo", "key", "size", "word", "n", F.inline(F.when(F.col("parts").isNull(), whole).otherwise(others)))


class Matcher:
    """Finds the near pairs of the sorted rows of one combo."""

    def __init__(self, combo: int, part: np.ndarray):
        self.combo, self.part = combo, part
        self.free = np.flatnonzero([part[x] not in COMBOS[combo] for x in range(LETTERS)])
        # parts that differ (as bits) -> the first combo that avoids them
        self.home = np.array([next((i for i, c in enumerate(COMBOS) if not any(bits >> p & 1 for p in c)), -1) for bits in range(1 << PARTS)])

    def pairs(self, group: np.ndarray, side: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (a, b) of near words; rows are ordered by group and length."""
        letters = Letters(words)
        counts = letters.counts()
        free = counts[:, self.free].astype(np.float64)
        norm = np.einsum("ij,ij->i", free, free)
        size = letters.size
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def product(a: slice, b: slice) -> None:
            far = norm[a, None] + norm[None, b] - 2.0 * (free[a] @ free[b].T)
            i, j = np.nonzero((far > 0.5) & (far < 2.5))
            i, j = i + a.start, j + b.start
            # squared distance 2 at equal length, 1 at adjacent lengths; of equal lengths each pair once
            d = size[j] - size[i]
            good = (group[i] == group[j]) & (((d == 0) & (i < j)) | (d == 1)) & ((side[i] == 0) | (side[i] != side[j]))
            if good.any():
                found.append((i[good], j[good]))

        def rectangle(lo: int, hi: int, lo2: int, hi2: int) -> None:
            for x in range(lo, hi, ROWS):
                for y in range(max(lo2, x) if lo == lo2 else lo2, hi2, ROWS):
                    product(slice(x, min(x + ROWS, hi)), slice(y, min(y + ROWS, hi2)))

        edge = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (size[1:] != size[:-1]), [True])))
        opens = np.concatenate(([True], group[edge[1:-1]] != group[edge[1:-1] - 1]))  # a block's first length
        small_from = small_to = 0  # neighbouring small groups share a product
        k, last = 0, len(edge) - 1
        while k < last:
            end = k + 1
            while end < last and not opens[end]:
                end += 1
            lo, hi = int(edge[k]), int(edge[end])
            if hi - lo <= 96:
                if hi - small_from > 128:
                    product(slice(small_from, small_to), slice(small_from, small_to))
                    small_from = lo
                small_to = hi
            else:
                if small_to > small_from:
                    product(slice(small_from, small_to), slice(small_from, small_to))
                small_from = small_to = hi
                for x in range(k, end):
                    rectangle(int(edge[x]), int(edge[x + 1]), int(edge[x]), int(edge[x + 1]))
                    if x + 1 < end and size[edge[x + 1]] == size[edge[x]] + 1:
                        rectangle(int(edge[x]), int(edge[x + 1]), int(edge[x + 1]), int(edge[x + 2]))
            k = end
        if small_to > small_from:
            product(slice(small_from, small_to), slice(small_from, small_to))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = []
        step = max(1, (1 << 21) // int(size.max()))
        for x in range(0, len(a), step):
            i, j = a[x : x + step], b[x : x + step]
            near = letters.one_edit(i, j)
            i, j = i[near], j[near]
            bits = np.zeros(len(i), np.int64)
            for p in range(PARTS):
                bits |= (counts[i][:, self.part == p] != counts[j][:, self.part == p]).any(axis=1).astype(np.int64) << p
            first = self.home[bits] == self.combo
            kept.append((i[first], j[first]))
        return np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n): both directions of every pair one edit apart."""
    part = deal_letters(words)
    dealt = _blocks(materialise(_keys(words, part), "word-keys"), tile)
    order = ["combo", "key", "block", "size", "side", "word"]
    placed = dealt.repartition("combo", "key", "block").sortWithinPartitions(*order)

    def match(table: pa.Table) -> Iterator[pa.RecordBatch]:
        combo, key, block, side = (table.column(c).to_numpy() for c in ("combo", "key", "block", "side"))
        words, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        for c in np.unique(combo):
            lo, hi = np.searchsorted(combo, c), np.searchsorted(combo, c, "right")
            group = np.cumsum(np.concatenate(([0], (key[lo + 1 : hi] != key[lo : hi - 1]) | (block[lo + 1 : hi] != block[lo : hi - 1]))))
            a, b = Matcher(int(c), part).pairs(group, side[lo:hi], words.slice(lo, hi - lo))
            if len(a):
                one, other = pa.array(np.concatenate((a, b)) + lo), pa.array(np.concatenate((b, a)) + lo)
                yield pa.RecordBatch.from_arrays([words.take(one), words.take(other), n.take(other)], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 15:
                continue
            table = pa.Table.from_batches(held)
            # the last block may go on in the next batch
            combo, key, block = (table.column(c).to_numpy() for c in ("combo", "key", "block"))
            cut = np.flatnonzero((combo != combo[-1]) | (key != key[-1]) | (block != block[-1]))
            done = int(cut[-1]) + 1 if len(cut) else 0
            yield from match(table.slice(0, done)) if done else ()
            held = table.slice(done).combine_chunks().to_batches()
            rows = table.num_rows - done
        if rows:
            yield from match(pa.Table.from_batches(held))
        release_memory()

    return placed.select(*order, "n").mapInArrow(run, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer jumping: counts
    grow at least ``RATIO``-fold along forms, so a few rounds reach the end."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word."""
    words = count_words(docs, id_col, text_col)
    best = near_words(words, tile).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best")
    )
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= RATIO * F.col("n")
    found = materialise(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

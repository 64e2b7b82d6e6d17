"""Phrase collocations from weighted acyclic automata of word sequences.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those at blanks and tabs into words; everything is counted per language (null:
``und``), over all sequences of 1 to 3 words of a piece, overlaps included.

1. Borders: a sample of sequences, chosen by hashes, gives borders between
   prefix ranges of about equal use.  They only spread the work.
2. Count: a task counts its texts slice by slice as sorted sequences, unites
   the slices' counts, cuts them at the borders and sends each range its part
   as a minimal automaton (:mod:`transducer`).
3. Union: a range's automata are united and their counts summed.  What occurs
   less than ``LEAST`` times goes; every part of a candidate occurs as often as
   the candidate at least.
4. Ask: a range sends the words and word pairs that its candidates are cut
   into, as automata again, to the ranges where they are counted, with the
   largest count of a longer candidate that asks.
5. Answer: there the questions are composed with the range's automaton; the
   counts go back.  Pairs of words that a longer candidate covers by half are
   marked at home.
6. Score: the answers are composed with the candidates; scores are exact
   integers.  A range passes on its ``TOP`` best of a language, and a window
   ranks these.

A task holds one range's counts (about the size of a shuffle partition) and
one automaton that arrives for it.  Ranges are cut inside common prefixes too,
so a frequent word does not make a large range; a language with a third of all
rows has as many ranges as its share.

Edge cases: null and empty texts have no words; null ids, other columns and
repeated rows do not matter (rows count as often as they occur); a language
without candidates has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import LOWER, UPPER, chunks, materialise, release_memory
from tablework.llm.transducer import DEPTH, Automaton, Counts, pack

LEAST, TOP, COVER = 10, 2000, 50
SCALE = 1_000_000
UNKNOWN = "und"
#: Sampled sequences a range; sequences a task holds before it passes them on.
SAMPLES, HELD = 16, 3_000_000

#: Characters that end a piece, and those that separate words in it (fixed values).
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True
_GAP = _STOP.copy()
_GAP[list(BLANKS)] = True
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TO_BLANK = bytes(0x20 if _GAP[b] else b for b in range(256))

ROWS = "rid int, lang string, origin int, total long, data binary"
_TABLE, _FLAGS = -2, -1  # what is no answer in ``origin``; they sort first


def tokenise(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(sorted distinct words, word numbers in order, piece numbers)."""
    raw = b"\n".join(texts).translate(_LOWER)
    data = np.frombuffer(raw + b"\n", np.uint8)
    starts = np.flatnonzero(np.diff(np.concatenate(([True], _GAP[data])).astype(np.int8)) == -1)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in raw.translate(_TO_BLANK).split(b" ") if w), np.int64, len(starts))
    words = sorted(seen)
    rank = np.empty(len(words), np.int64)
    rank[[seen[w] for w in words]] = np.arange(len(words))
    return words, rank[ids] if len(ids) else ids, np.cumsum(_STOP[data])[starts]


def _borders(docs: DataFrame, ranges: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """Sorted borders (lang, sequence) between about equally used ranges."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if ranges < 2 or not size:
        return []
    share, step = min(1.0, SAMPLES * ranges / n), max(1, size // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            rows = []
            for lang, h, text in zip(part.column("lang").to_pylist(), part.column("h").to_pylist(), texts, strict=True):
                words, ids, piece = tokenise([text])
                for i in range(-(-len(text) // step)):  # long texts give more
                    if len(ids):
                        at = (h + i * 0x9E3779B97F4A7C15) % (1 << 64) % len(ids)
                        inside = [words[x] for x, p in zip(ids[at : at + DEPTH], piece[at : at + DEPTH], strict=True) if p == piece[at]]
                        rows.append((lang, *inside, *[b""] * (DEPTH - len(inside))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string())] + [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)], ["lang", "a", "b", "c"])

    hashed = docs.select("lang", "text", F.xxhash64("lang", "text").alias("h"))
    chosen = hashed.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    taken = chosen.mapInArrow(run, "lang string, a binary, b binary, c binary")
    keys = taken.agg(F.sort_array(F.collect_list(F.struct("lang", "a", "b", "c"))).alias("ks"))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("ks", F.floor(i * F.size("ks") / F.lit(float(ranges))).cast("int")))
    found = {(r.lang, (bytes(r.a), bytes(r.b), bytes(r.c))) for r in keys.select(at.alias("s")).first().s if r is not None}
    return sorted(found, key=lambda x: (x[0].encode(), x[1]))


class Ranges:
    """Cuts the counts of a language at the borders."""

    def __init__(self, borders: list[tuple[str, tuple[bytes, ...]]]):
        self.langs = [lang.encode() for lang, _ in borders]
        self.keys = [key for _, key in borders]

    def cut(self, lang: str, counts: Counts) -> Iterator[tuple[int, Counts]]:
        raw = lang.encode()
        lo, hi = bisect_left(self.langs, raw), bisect_right(self.langs, raw)
        for k, part in counts.cut(self.keys[lo:hi]):
            yield lo + k, part


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    names = ("rid", "lang", "origin", "total", "data")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))


def _shards(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """Step 2: one row per flush of a task, language and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Counts]] = defaultdict(list)
        size = 0
        for part, texts in chunks(batches):
            by_lang: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                by_lang[lang].append(text)
            for lang, some in by_lang.items():
                words, ids, piece = tokenise(some)
                if len(ids):
                    held[lang].append(Counts.count(words, ids, piece))
                    size += len(held[lang][-1])
            if size >= HELD:
                yield from flush(held)
                size = 0
        yield from flush(held)

    def flush(held: dict[str, list[Counts]]) -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            for rid, part in ranges.cut(lang, Counts.union(held.pop(lang))):
                yield _rows([(rid, lang, _TABLE, 0, pack(part))])

    return docs.select("lang", "text").mapInArrow(run, ROWS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, Iterator[tuple[int, int, bytes]]]]:
    """(range, language, its (origin, total, data) rows) of sorted rows."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("rid", "lang", "origin", "total", "data")), strict=True)

    for (rid, lang), group in groupby(rows(), key=lambda r: r[:2]):
        yield rid, lang, (r[2:] for r in group)
    release_memory()


def _by_range(rows: DataFrame) -> DataFrame:
    return rows.repartition("rid").sortWithinPartitions("rid", "lang", "origin")


def _united(shards: DataFrame, least: int) -> DataFrame:
    """Step 3: one row per range and language; ``total`` counts its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, lang, group in _groups(batches):
            parts: list[Counts] = []
            fresh = 0
            for _, _, data in group:
                parts.append(Automaton(data).counts())
                fresh += len(parts[-1])
                if fresh >= max(HELD, len(parts[0])):
                    parts, fresh = [Counts.union(parts)], 0
            counts = Counts.union(parts)
            yield _rows([(rid, lang, _TABLE, int(counts.levels[0].weight.sum()), pack(counts.at_least(least)))])

    return _by_range(shards).mapInArrow(run, ROWS)


def candidates(counts: Counts, least: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(node numbers, word columns) of the two- and three-word candidates."""
    out = []
    for d in range(1, DEPTH):
        at = np.flatnonzero(counts.levels[d].weight >= least)
        labels, node = [], at
        for k in reversed(range(d + 1)):
            labels.insert(0, counts.levels[k].label[node])
            node = counts.levels[k].parent[node]
        out.append((at, labels))
    return out


def parts_asked(counts: Counts, least: int) -> Counts:
    """The words and word pairs that the candidates are cut into.  A pair's
    weight is the largest count of a longer candidate around it, plus one."""
    (_, two), (at, three) = candidates(counts, least)
    single = np.concatenate((two[0], two[1], three[0], three[2]))
    longer = counts.levels[2].weight[at] + 1
    return Counts.of(
        counts.words,
        [([single], np.ones(len(single), np.int64)), ([np.concatenate((three[0], three[1])), np.concatenate((three[1], three[2]))], np.concatenate((longer, longer)))],
        how=np.maximum,
    )


def _asked(united: DataFrame, ranges: Ranges, least: int) -> DataFrame:
    """Step 4: one row per asking and asked range and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, lang, data in zip(*(batch.column(c).to_pylist() for c in ("rid", "lang", "data")), strict=True):
                asked = parts_asked(Automaton(data).counts(), least)
                if len(asked):
                    for target, part in ranges.cut(lang, asked):
                        yield _rows([(target, lang, rid, 0, pack(part))])

    return united.mapInArrow(run, ROWS)


def _answered(united: DataFrame, asked: DataFrame) -> DataFrame:
    """Step 5: answers to the asking ranges, and marks for a range's own pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, lang, group in _groups(batches):
            table, longest = None, np.zeros(0, np.int64)
            for origin, _, data in group:
                if origin == _TABLE:
                    table = Automaton(data)
                    own = table.counts().levels[1].weight
                    longest = np.zeros(len(own), np.int64)
                    continue
                wanted = Automaton(data).counts()
                found, pair = table.compose(wanted)
                np.maximum.at(longest, pair[pair >= 0], wanted.levels[1].weight[pair >= 0] - 1)
                for level, weight in zip(wanted.levels, found, strict=True):
                    level.weight = np.where(level.weight > 0, weight, 0)
                yield _rows([(origin, lang, rid, 0, pack(wanted))])
            # counts stay below 2^56, so these products cannot overflow
            covered = (longest > 0) & (100 * longest >= COVER * own)
            yield _rows([(rid, lang, _FLAGS, 0, np.packbits(covered).tobytes())])

    return _by_range(united.unionByName(asked)).mapInArrow(run, ROWS)


def scored(counts: Counts, answers: Counts, covered: np.ndarray, least: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(score, a, phrase, l, r) of the candidates that stay."""
    lookup = Automaton(pack(answers))
    for (at, labels), d in zip(candidates(counts, least), (1, 2), strict=True):
        if d == 1:
            stay = ~covered[at]
            at, labels = at[stay], [x[stay] for x in labels]
        if not len(at):
            continue
        sides = []
        for k in range(1, d + 1):
            sides.append([_count_of(lookup, counts.words, labels[:k]), _count_of(lookup, counts.words, labels[k:])])
        for row, (phrase, a) in enumerate(zip(counts.text(d, at), counts.levels[d].weight[at].tolist(), strict=True)):
            best = None
            for left, right in sides:
                low, high = left[row], right[row]
                score = SCALE * a * a // (low * high)
                if best is None or score < best[0]:
                    best = (score, low, high)
            yield best[0], a, phrase, best[1], best[2]


def _count_of(lookup: Automaton, words: list[bytes], labels: list[np.ndarray]) -> list[int]:
    """The counts of sequences given as word columns, as Python integers."""
    distinct, number = np.unique(labels[0] if len(labels) == 1 else (labels[0] << 32) | labels[1], return_inverse=True)
    columns = [distinct] if len(labels) == 1 else [distinct >> 32, distinct & 0xFFFFFFFF]
    nothing = np.zeros(0, np.int64)
    shorter = [([nothing] * (k + 1), nothing) for k in range(len(columns) - 1)]
    found, _ = lookup.compose(Counts.of(words, [*shorter, (columns, np.ones(len(distinct), np.int64))]))
    return found[len(columns) - 1][number].tolist()


def _best(united: DataFrame, answered: DataFrame, least: int, top: int) -> DataFrame:
    """Step 6, without the ranks over several ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lang, group in _groups(batches):
            counts, covered, answers = None, np.zeros(0, bool), []
            for origin, _, data in group:
                if origin == _TABLE:
                    counts = Automaton(data).counts()
                elif origin == _FLAGS:
                    covered = np.unpackbits(np.frombuffer(data, np.uint8), count=len(counts.levels[1])).astype(bool)
                else:
                    answers.append(Automaton(data).counts())
            if not answers:
                continue
            rows = heapq.nsmallest(top, scored(counts, Counts.union(answers), covered, least), key=lambda x: (-x[0], -x[1], x[2]))
            score, a, phrase, low, high = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [pa.array([lang] * len(rows), pa.string()), pa.array([p.decode() for p in phrase], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.int64()) for x in (a, low, high, score)], ["lang", "phrase", "a", "l", "r", "score"])

    return _by_range(united.unionByName(answered)).mapInArrow(run, "lang string, phrase string, a long, l long, r long, score long")


def mine_phrases(docs: DataFrame, ranges: int | None = None, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` of each language."""
    spark = docs.sparkSession
    language: Column = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    source = docs.select(language.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cutter = Ranges(_borders(source, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    united = materialise(_united(_shards(source, cutter), least), "phrase-counts")
    answered = materialise(_answered(united, _asked(united, cutter, least)), "phrase-answers")
    best = materialise(_best(united, answered, least, top), "phrase-scores")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = united.groupBy("lang").agg(F.sum("total").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

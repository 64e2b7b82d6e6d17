"""Substring dedup by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one text.  Every word covered by a
window whose words also start anywhere else, the same text included, goes.

1. Candidates: the hash of every window of every text, with its place, goes to
   its hash range in packed blocks; sorted with numpy there, equal hashes name
   the windows that may repeat, and the first of each group (smallest row, then
   place) is the group's reference.
2. Reference shards: the reference windows of one stretch of a text are one
   reference passage; each distinct repeated window is in exactly one.  Shards
   are hash groups of such stretches of about ``SHARD_WORDS`` words in all.
3. Each task builds the suffix automaton of a shard's passages and streams
   through it the other stretches whose windows refer to that shard: the
   matching statistics (longest match ending at each word) say, word for word
   and without hashes, which windows occur in the reference, and mark those of
   the reference that somebody else has.
4. Maximal spans of covered words are removed from the texts.

A broadcast of the automata of the whole corpus to all documents would grow
with its square and has no size bound; so each stretch is sent to the shards
that can match it, which are known from step 1, and sees no other.

Edge cases: null and empty texts have no words and the digest of the empty
string; texts shorter than a window lose nothing; repeated rows repeat each
other and lose all their windows; null ids take part like others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import chunks, id_and_text, join_ids, materialise, release_memory
from tablework.llm.shingles import Words

WINDOW = 35
BLOCK_BYTES = 32 << 20
PARTITION_BYTES = 12 << 20
SHARD_WORDS = 100_000
#: Windows of one text that may be one stretch; longer ones are cut, so that a
#: very long text is spread over shards.
STRETCH = 8192
KEY_BYTES = 7
KEY_MASK = np.uint64((1 << 56) - 1)
WHOLE = 1 << 40  # as a number of windows: all of a text


def _cut_runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows equal in all ``keys``."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Bytes of small integers, all low bytes first: the high ones compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def _raw(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_raw(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").ravel()


def _emit(window: int, buckets: int):
    """(bucket, block): of each bucket the rows, counts, places and hashes."""

    def block(held: list[tuple]) -> pa.RecordBatch:
        key, row, place = (np.concatenate([h[k] for h in held]) for k in range(3))
        bucket = ((key >> np.uint64(48)).astype(np.int64) * buckets >> 16).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, row, place = key[order] & KEY_MASK, row[order], place[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(ends)):
            part = slice(ends[b], ends[b + 1])
            # a run: one row; places as steps of 16 bits, a longer step starts a new run
            step = np.diff(place[part], prepend=0)
            runs = _cut_runs(row[part], np.cumsum((step > 0xFFFF) | (step < 0)))
            step[runs] = 0
            head = np.array([len(runs), len(step)], "<i8").tobytes() + row[part][runs].astype("<i8").tobytes() + place[part][runs].astype("<i8").tobytes()
            head += np.diff(np.append(runs, len(step))).astype("<i8").tobytes()
            out.append((int(b), head + _planes(step, 2) + _raw(key[part], KEY_BYTES)))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, texts in chunks(batches, max_bytes=2 << 20):
            words = Words(texts)
            at, key = words.windows(window)
            doc = words.doc[at]
            held.append((key, np.asarray(part.column("row"))[doc], at - words.first[doc]))
            size += 24 * len(key)
            if size >= BLOCK_BYTES:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    return run


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    runs, n = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    row, first, count = (np.frombuffer(raw, "<i8", runs, 16 + 8 * runs * k) for k in range(3))
    at = 16 + 24 * runs
    step = _from_planes(raw, at, n, 2).astype(np.int64)
    total = np.cumsum(step)
    starts = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = total - np.repeat(total[starts], count) + np.repeat(first, count)
    return _from_raw(raw, at + 2 * n, n, KEY_BYTES), np.repeat(row, count), place


def repeated(key: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place, reference row, reference place) of windows whose hash
    occurs twice or more; the reference is the smallest (row, place)."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    twice = np.zeros(len(key), bool)
    same = ranked[1:] == ranked[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    pick = order[twice]
    key, row, place = key[pick], row[pick], place[pick]
    order = np.lexsort((place, row, key))
    key, row, place = key[order], row[order], place[order]
    start = _cut_runs(key)
    count = np.diff(np.append(start, len(key)))
    return row, place, np.repeat(row[start], count), np.repeat(place[start], count)


def _match(parts: int):
    """Per bucket the repeated windows, sent to the part that collects their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                held.setdefault(bucket, []).append(raw)
        for bucket in sorted(held):
            row, place, ref, ref_place = repeated(*(np.concatenate(x) for x in zip(*map(_unpack, held.pop(bucket)), strict=True)))
            part = (row.astype(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((place, ref, row, part))
            row, place, ref, ref_place, part = (x[order] for x in (row, place, ref, ref_place, part))
            ends = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(ends)):
                s = slice(ends[p], ends[p + 1])
                runs = _cut_runs(row[s], ref[s])
                raw = np.array([len(runs), ends[p + 1] - ends[p]], "<i8").tobytes() + row[s][runs].astype("<i8").tobytes() + ref[s][runs].astype("<i8").tobytes()
                raw += np.diff(np.append(runs, ends[p + 1] - ends[p])).astype("<i8").tobytes()
                out.append((int(p), raw + _planes(place[s], 4) + _planes(ref_place[s], 4)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "block"])
        release_memory()

    return run


STRETCHES = "row long, place long, n long, ref long, ref_place long"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows whose references run along: (row, place, number of
    windows, reference row, reference place)."""
    held: dict[int, list[tuple]] = {}
    for b in batches:
        for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
            runs, n = (int(x) for x in np.frombuffer(raw, "<i8", 2))
            row, ref, count = (np.frombuffer(raw, "<i8", runs, 16 + 8 * runs * k) for k in range(3))
            at = 16 + 24 * runs
            held.setdefault(bucket, []).append((np.repeat(row, count), _from_planes(raw, at, n, 4).astype(np.int64), np.repeat(ref, count), _from_planes(raw, at + 4 * n, n, 4).astype(np.int64)))
    for bucket in sorted(held):
        row, place, ref, ref_place = (np.concatenate(x) for x in zip(*held.pop(bucket), strict=True))
        order = np.lexsort((place, row))
        row, place, ref, ref_place = (x[order] for x in (row, place, ref, ref_place))
        along = place - np.arange(len(place))
        start = _cut_runs(row, ref, along, ref_place - np.arange(len(place)), ref_place // STRETCH)
        n = np.diff(np.append(start, len(row)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row[start], place[start], n, ref[start], ref_place[start])], names=["row", "place", "n", "ref", "ref_place"])


class SuffixAutomaton:
    """Of sequences of words; each state keeps where its strings first end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        self.size = 0

    def add(self, words: list[bytes]) -> int:
        """Append a sequence after a separator that matches nothing; the
        position of its first word."""
        last, begin = 0, self.size
        nxt, link, length, end = self.next, self.link, self.length, self.end
        for word in words:
            old = nxt[last].get(word)
            if old is not None and length[old] == length[last] + 1:  # known from an earlier sequence
                last = old
                self.size += 1
                continue
            cur = len(nxt)
            if old is None:
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                end.append(self.size)
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = cur
                    p = link[p]
                q = nxt[p][word] if p >= 0 else 0
                made = cur
            else:
                p, q, made = last, old, -1
            if p >= 0 and length[q] != length[p] + 1:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(end[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            if made >= 0:
                link[made] = q
                last = made
            else:
                last = q
            self.size += 1
        return begin

    def ends(self, words: list[bytes], window: int) -> tuple[list[int], list[int]]:
        """Matching statistics of ``words`` at the window's length: places where
        a window ends that occurs in the automaton, and where it first ends."""
        nxt, link, length, end = self.next, self.link, self.length, self.end
        state = matched = 0
        at, there = [], []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            if matched >= window:
                while length[link[state]] >= window:  # the state that holds the string of just the window's length
                    state = link[state]
                matched = min(matched, length[state])
                at.append(i)
                there.append(end[state])
        return at, there


SPANS = "row long, place long, n long"


def _automata(window: int):
    """Rows come shard by shard, reference passages (role 0) first."""

    def spans(row: int, base: int, ends: np.ndarray) -> list[tuple[int, int, int]]:
        start = _cut_runs(ends - np.arange(len(ends)))
        n = np.diff(np.append(start, len(ends)))
        return [(row, base + int(ends[s]) - window + 1, int(k)) for s, k in zip(start, n, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, found = None, []

        def close() -> None:
            for k, ends in enumerate(hit):
                if ends:
                    found.extend(spans(owner[k][0], owner[k][1], np.array(sorted(ends)) - begins[k]))

        for b in batches:
            for s, role, rows, places, text in zip(*(b.column(c).to_pylist() for c in ("shard", "role", "rows", "places", "words")), strict=True):
                if s != shard:
                    if shard is not None:
                        close()
                    shard, automaton, begins, owner, hit = s, SuffixAutomaton(), [], [], []
                words = text.split(b" ")
                if role == 0:
                    begins.append(automaton.add(words))
                    owner.append((rows[0], places[0]))
                    hit.append(set())
                    continue
                at, there = automaton.ends(words, window)
                for end, k in zip(there, np.searchsorted(begins, there, "right") - 1, strict=True):
                    hit[k].add(end)
                if at:
                    for row, place in zip(rows, places, strict=True):
                        found.extend(spans(row, place, np.array(at)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["row", "place", "n"])
            found.clear()
        if shard is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["row", "place", "n"])

    return run


def _passages(window: int):
    """The words of each stretch of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            found: dict[tuple, list] = {}
            for row, stretches, text in zip(part.column("row").to_pylist(), part.column("stretches").to_pylist(), texts, strict=True):
                words = text.split()
                for s in stretches:
                    own = s["ref"] == row and s["ref_place"] == s["place"]
                    key = (s["ref"], s["ref_place"] // STRETCH, int(not own), b" ".join(words[s["place"] : s["place"] + s["n"] + window - 1]))
                    found.setdefault(key, []).append((row, s["place"]))
            columns = [pa.array([k[i] for k in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
            at = [pa.array([[p[i] for p in sorted(set(v))] for v in found.values()], pa.list_(pa.int64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*columns, *at], names=["ref", "piece", "role", "words", "rows", "places"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, place, n): the n windows of text ``row`` (hash of id and text) that
    start at word ``place`` and on occur elsewhere too.  ``docs`` has row, text."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(1, -(-size // PARTITION_BYTES))
    buckets = min(partitions, 1 << 16)
    emitted = docs.mapInArrow(_emit(window, buckets), "bucket int, block binary").repartition(partitions, "bucket")
    sent = emitted.mapInArrow(_match(buckets), "bucket int, block binary").repartition(partitions, "bucket")
    stretches = materialise(sent.mapInArrow(_stretches, STRETCHES), "stretches")
    own = stretches.where("row = ref and place = ref_place")
    words = own.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0))).first()[0]
    shards = max(1, -(-words // SHARD_WORDS))
    grouped = stretches.distinct().groupBy("row").agg(F.collect_list(F.struct("place", "n", "ref", "ref_place")).alias("stretches"))
    # only the texts with repeated windows move
    texts = join_ids(docs, stretches.select("row").distinct(), column="row").join(grouped.hint("shuffle_merge"), "row")
    # equal stretches of a slice that refer to one passage are streamed once, for all their places
    pieces = texts.mapInArrow(_passages(window), "ref long, piece long, role int, words binary, rows array<long>, places array<long>")
    pieces = pieces.select(F.pmod(F.xxhash64("ref", "piece"), F.lit(shards)).alias("shard"), "role", "rows", "places", "words")
    n = max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = pieces.repartition(n, "shard").sortWithinPartitions("shard", "role").mapInArrow(_automata(window), SPANS)
    # repeated rows have one number: all their windows start in the other row too
    twice = docs.groupBy("row").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("row", F.lit(0).cast("long").alias("place"), F.lit(WHOLE).cast("long").alias("n"))
    return found.unionByName(twice)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the kept words joined by one
    space), n_words, n_removed and the removed spans (word places, end exclusive)."""
    source = id_and_text(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    spans = materialise(repeated_spans(source.select("row", "text"), window), "repeats")
    per_row = spans.groupBy("row").agg(F.collect_set(F.struct("place", "n")).alias("spans"))
    # texts without repeats stay where they are
    touched = spans.select("row").distinct()
    with_spans = join_ids(source, touched, column="row").join(per_row.hint("shuffle_merge"), "row").select("doc_id", "text", "spans")
    untouched = join_ids(source, touched, "left_anti", "row").select("doc_id", "text", F.lit(None).cast(per_row.schema["spans"].dataType).alias("spans"))
    joined = with_spans.unionByName(untouched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            out: dict[str, list] = {k: [] for k in ("text", "n_words", "n_removed", "removed")}
            for found, text in zip(part.column("spans").to_pylist(), texts, strict=True):
                words = text.split()
                gone, merged = bytearray(len(words)), []
                for s in sorted(found or [], key=lambda s: s["place"]):
                    if len(words) < window:  # a repeated row without a window
                        break
                    start, end = s["place"], min(len(words), s["place"] + s["n"] + window - 1)
                    gone[start:end] = b"\x01" * (end - start)
                    if merged and start <= merged[-1]["end"]:
                        merged[-1]["end"] = max(end, merged[-1]["end"])
                    else:
                        merged.append({"start": start, "end": end})
                out["text"].append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if merged else b" ".join(words))
                out["n_words"].append(len(words))
                out["n_removed"].append(sum(gone))
                out["removed"].append(merged)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(out["text"], pa.binary()).cast(pa.string()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["removed"], span)],
                names=["doc_id", "text", "n_words", "n_removed", "removed"],
            )

    return joined.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:long,end:long>>")

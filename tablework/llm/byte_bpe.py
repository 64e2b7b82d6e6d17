"""Byte-level BPE with Spark higher-order functions.

1. A first Python step splits whole texts by the pattern and numbers the
   distinct words of its task; each is sent on once, as an array of bytes, with
   the texts as sequences of word numbers.
2. The merges run in the JVM on the distinct words: of each word, the parts
   that are pieces are looked up in a literal rank table and sorted by rank, and
   ``aggregate`` folds over them, joining a part when it consists of exactly two
   tokens.  That is the rule of joining the pair of lowest rank (the leftmost of
   equals) as long as merges come in rising order of rank, which is checked for
   the whole vocabulary.  The literal is an open-addressing table in one array,
   so that a look-up costs the same for any vocabulary.  A second one has the
   length of the longest piece by its head, so that longer parts are not tried.
3. A second Python step replaces word numbers by ids, and decodes: the pieces
   of the ids, concatenated.

The three run in one stage, slice by slice and in order; there is no shuffle,
and a task holds one slice and at most ``TASK_WORDS`` distinct words.

A word of more than ``LONG_WORD`` bytes would cost a fold the square of its
length, so its merges use a heap in the second step, by the same rule; the
words are whole all the same.

Edge cases: null and empty texts have no ids and the digest of the empty
string; repeated rows are encoded one by one; null ids pass through; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import chunks, id_and_text, release_memory

LONG_WORD = 32
TASK_WORDS = 1_500_000
#: Text of a task: a word is sent on once a task, so small scan splits are joined.
TASK_BYTES = 72 << 20
SLICE_BYTES = 1 << 20
HEAD = 3
ID_BITS = 17
NONE = 1 << ID_BITS  # above all ids

SPLIT = "doc_ids array<long>, counts array<int>, refs binary, fresh array<binary>, long array<binary>, reset boolean"
ENCODED = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file, by id."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, filter(bytes.strip, f))}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ranks are not 0 to {len(found) - 1}")
    return [found[i] for i in range(len(found))]


def merge_ranks(word: bytes, number: dict[bytes, int]) -> list[int]:
    """Ranks of the merges of a short word, in order."""
    parts, ranks = [word[i : i + 1] for i in range(len(word))], []
    while True:
        found = min(((number[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in number), default=None)
        if found is None:
            return ranks
        ranks.append(found[0])
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


def check_order(pieces: list[bytes]) -> None:
    """Raise unless the merges of every piece come in rising rank order.

    Then they do so in every word: were a pair of lower rank to arise from a
    merge, the piece it joins to would show the same in itself.  Trained
    vocabularies have this property; the fold over ranked candidates needs it.
    """
    number = {p: i for i, p in enumerate(pieces)}
    for p in pieces:
        ranks = merge_ranks(p, number)
        if ranks != sorted(ranks):
            raise ValueError(f"the merges of {p!r} are not in rank order")


class RankTable:
    """Ranks by the hash of a piece: open addressing in one array of integers.
    An entry is the hash with its low ``ID_BITS`` bits replaced by the rank; 0
    is free; ``probes`` neighbouring places hold every piece."""

    def __init__(self, hashes: list[int]):
        self.bits = max(4, (8 * len(hashes)).bit_length())
        self.slots = [0] * ((1 << self.bits) + 64)
        self.probes = 1
        low = (1 << ID_BITS) - 1
        if len({h >> ID_BITS for h in hashes}) < len(hashes):
            raise ValueError("two pieces share a hash")
        for rank, h in enumerate(hashes):
            at = h & ((1 << self.bits) - 1)
            while self.slots[at]:
                at += 1
            self.slots[at] = (h & ~low) | rank
            self.probes = max(self.probes, at - (h & ((1 << self.bits) - 1)) + 1)

    def literal(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.slots, separators=(",", ":"))), "array<bigint>")

    def _place(self, piece: Column) -> Column:
        return F.xxhash64(piece).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")

    def maybe(self, table: Column, piece: Column) -> Column:
        """False for most byte strings that are no piece: one look-up."""
        return F.get(table, self._place(piece)) != 0

    def rank(self, table: Column, piece: Column) -> Column:
        """The rank (id) of a piece, else ``NONE``."""

        def probe(k: int, place: Column, h: Column) -> Column:
            if k == self.probes:
                return F.lit(NONE)

            def hit(slot: Column) -> Column:
                mine = F.shiftright(slot, ID_BITS) == F.shiftright(h, ID_BITS)
                return F.when(slot == 0, F.lit(NONE)).when(mine, slot.bitwiseAND(F.lit(NONE - 1))).otherwise(probe(k + 1, place, h))

            return let(F.get(table, place + k), hit)

        return let(F.xxhash64(piece), lambda h: probe(0, h.bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int"), h))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; lambda bodies are interpreted,
    and Spark computes a repeated expression as often as it is written there.
    A fold over no element hands its start value to ``body`` as it is."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def bound(literal: Column, body) -> Column:
    """``body`` of a literal that the plan holds once."""
    return F.get(F.transform(F.array(literal), body), 0)


def _left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


class Reach:
    """The length of the longest piece that begins like a part, by the hash of
    its first ``HEAD`` bytes; heads that share a place share the larger one."""

    def __init__(self, pieces: list[bytes], head_hashes: list[int]):
        self.bits = max(4, (8 * len(set(head_hashes))).bit_length())
        self.slots = [HEAD - 1] * (1 << self.bits)  # shorter parts are looked up in any case
        for p, h in zip(pieces, head_hashes, strict=True):
            at = h & ((1 << self.bits) - 1)
            self.slots[at] = max(self.slots[at], min(len(p), LONG_WORD))

    def literal(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.slots, separators=(",", ":"))), "array<int>")

    def longest(self, table: Column, head: Column) -> Column:
        return F.get(table, F.xxhash64(head).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int"))


def fold_merges(table: Column, ranks: RankTable, word: Column, reach_table: Column, reach: Reach) -> Column:
    """Ids of one word (binary, at most ``LONG_WORD`` bytes).

    The state of the fold is the set of token borders, one bit each.  The
    word's parts that are pieces are taken in the order of their ranks, the
    leftmost first; such a part is joined if both its ends are borders and
    exactly one border lies within, which goes.
    """
    one = F.lit(1).cast("bigint")

    def join(borders: Column, c: Column) -> Column:
        start, size = F.shiftright(c, 6).bitwiseAND(F.lit(63)).cast("int"), c.bitwiseAND(F.lit(63)).cast("int")
        ends = _left(one + _left(one, size), start)

        def merge(inner: Column) -> Column:
            return F.when((inner != 0) & (inner.bitwiseAND(inner - 1) == 0), borders.bitwiseXOR(inner)).otherwise(borders)

        # borders strictly inside the part
        inside = borders.bitwiseAND(_left(_left(one, size) - 2, start))
        return F.when(borders.bitwiseAND(ends) == ends, let(inside, merge)).otherwise(borders)

    def ids(borders: Column, n: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), n), lambda b: _right(borders, b).bitwiseAND(one) == 1)
        return let(
            places, lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda b, k: ranks.rank(table, F.substring(word, b + 1, F.get(at, k + 1) - b)).cast("int"))
        )

    def merged(n: Column) -> Column:
        def parts(i: Column) -> Column:
            most = F.least(n - i, reach.longest(reach_table, F.substring(word, i + 1, HEAD)))
            sizes = F.filter(F.sequence(F.lit(2), most), lambda size: ranks.maybe(table, F.substring(word, i + 1, size)))
            # rank, start and size are one number, so that sorting numbers sorts by rank, then place
            return F.transform(sizes, lambda size: ranks.rank(table, F.substring(word, i + 1, size)) * 4096 + (i * 64 + size))

        found = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), parts))
        ranked = F.sort_array(F.filter(found, lambda c: c < NONE * 4096))
        return let(F.aggregate(ranked, _left(one, n + 1) - 1, join), lambda borders: ids(borders, n))

    single = F.array(ranks.rank(table, word).cast("int"))
    return let(F.length(word), lambda n: F.when(n > 1, merged(n)).when(n == 1, single).otherwise(F.array().cast("array<int>")))


def heap_merges(word: bytes, number: dict[bytes, int]) -> list[int]:
    """The same rule for a long word: lowest rank first, leftmost of equals."""
    ends = list(range(1, len(word) + 1))  # end of the piece that starts here, 0 once it is joined to the left
    before, starts = list(range(-1, len(word) - 1)), set()
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and ends[i] < len(word):
            j = ends[i]
            if (r := number.get(word[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

    for i in range(len(word)):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if not j or j >= len(word) or ends[j] != end or i in starts:
            continue
        ends[i], ends[j] = end, 0
        starts.add(j)
        if end < len(word):
            before[end] = i
        push(i)
        push(before[i])
    return [number[word[i : ends[i]]] for i in range(len(word)) if i not in starts]


def _finder(pattern: str):
    """All matches in a text.  In texts of Latin-1 characters the classes of the
    pattern are written out, which ``re`` is quicker at."""
    import regex

    whole = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    find, latin = regex.compile(whole).findall, whole
    for name in ("L", "N", "White_Space"):
        members = "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(rf"\p{{{name}}}", chr(c)))
        # within a class of several the members alone
        latin = regex.sub(rf"(?<=\[[^\]]*)\\p{{{name}}}", lambda _: members, latin)  # noqa: B023
        latin = latin.replace(rf"\p{{{name}}}", f"[{members}]").replace(rf"\P{{{name}}}", f"[^{members}]")
    find_latin = re.compile(latin).findall if r"\p" not in latin.lower() else find

    def run(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return find(text)
        return find_latin(text)

    return run


def _split(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(pattern)
        known: dict[str, int] = defaultdict(count().__next__)
        for part, texts in chunks(batches, max_bytes=SLICE_BYTES):
            reset = len(known) > TASK_WORDS
            if reset:
                known = defaultdict(count().__next__)
            before, counts, refs = len(known), [], array("i")
            for t in texts:
                split = find(t.decode("utf-8", "replace"))
                counts.append(len(split))
                refs.extend(map(known.__getitem__, split))  # a new word gets the next number
            fresh = [w.encode() for w in islice(reversed(known), len(known) - before)][::-1]
            short = [w if len(w) <= LONG_WORD else b"" for w in fresh]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([refs.tobytes()], pa.binary()),
                    pa.array([short], pa.list_(pa.binary())),
                    pa.array([[w for w in fresh if len(w) > LONG_WORD]], pa.list_(pa.binary())),
                    pa.array([reset]),
                ],
                names=["doc_ids", "counts", "refs", "fresh", "long", "reset"],
            )
        del known
        release_memory()

    return run


class _Grown:
    """An array that is appended to, with room to spare."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            room = np.zeros((self.n + len(more)) * 3 // 2, self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


def _assemble(pieces: list[bytes], with_ids: bool):
    number = {p: i for i, p in enumerate(pieces)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, start = _Grown(np.int32), _Grown(np.int64)  # ids of all words so far, and where each word's begin
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                if row.column("reset")[0].as_py():
                    flat, start = _Grown(np.int32), _Grown(np.int64)
                words = row.column("encoded").flatten()
                values, lengths = np.asarray(words.flatten()).astype(np.int32), np.asarray(pa.compute.list_value_length(words)).astype(np.int64)
                if long := row.column("long")[0].as_py():
                    # words without short bytes, in order
                    merged = [np.array(heap_merges(w, number), np.int32) for w in long]
                    parts, ends, at = [], np.cumsum(lengths), 0
                    for k, m in zip(np.flatnonzero(lengths == 0), merged, strict=True):
                        parts += [values[at : ends[k]], m]
                        at = int(ends[k])
                        lengths[k] = len(m)
                    values = np.concatenate([*parts, values[at:]])
                start.append(flat.n + np.cumsum(lengths) - lengths)
                flat.append(values)
                refs = np.frombuffer(row.column("refs")[0].as_buffer(), np.int32)
                begin = start.room[refs]
                n = np.where(refs + 1 < start.n, start.room[np.minimum(refs + 1, start.n - 1)], flat.n) - begin
                total = np.concatenate(([0], np.cumsum(n)))
                ids = flat.room[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
                bounds = total[np.concatenate(([0], np.cumsum(row.column("counts")[0].as_py())))].astype(np.int64)
                out: dict[str, list] = {"ids": [], "ids_sha256": [], "decoded_sha256": []}
                get = pieces.__getitem__
                for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                    raw = ids[i:j].astype("<u4").tobytes()
                    out["ids"].append(raw if with_ids else None)
                    out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(b"".join(map(get, ids[i:j].tolist()))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids").flatten(), pa.array(np.diff(bounds)), pa.array(out["ids"], pa.binary()), pa.array(out["ids_sha256"]), pa.array(out["decoded_sha256"])],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )
        del flat, start
        release_memory()

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ids (binary, 32-bit little-endian, if asked
    for), their number, and the digests of ids and of the decoded bytes."""
    pieces = read_ranks(rank_file)
    check_order(pieces)
    numbered = docs.sparkSession.createDataFrame(list(enumerate(pieces)), "i int, p binary")
    hashes = numbered.select("i", F.xxhash64("p").alias("h"), F.xxhash64(F.substring("p", 1, HEAD)).alias("b")).orderBy("i").collect()  # two numbers a piece
    ranks, reach = RankTable([r.h for r in hashes]), Reach(pieces, [r.b for r in hashes])
    source = id_and_text(docs, id_col, text_col)
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    split = source.coalesce(max(1, size // TASK_BYTES)).mapInArrow(_split(pattern), SPLIT)
    # the tables are bound once, as variables, so that the plan holds one literal of each
    encoded = bound(ranks.literal(), lambda table: bound(reach.literal(), lambda most: F.transform("fresh", lambda word: fold_merges(table, ranks, word, most, reach))))
    merged = split.select("doc_ids", "counts", "refs", "long", "reset", encoded.alias("encoded"))
    return merged.mapInArrow(_assemble(pieces, with_ids), ENCODED)


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id and the bytes of ``ids``: the pieces, concatenated."""
    pieces = read_ranks(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b"".join(pieces[i] for i in np.frombuffer(raw or b"", "<u4")) for raw in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")

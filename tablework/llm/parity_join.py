"""Near-duplicate join on word shingles by parity sketches.

A document's set is its distinct ``SHINGLE``-word shingles.  Two sets link when
their Jaccard similarity is at least ``PERCENT`` / 100, so their symmetric
difference is at most ``(100 - PERCENT) / (100 + PERCENT)`` of the sum of their
sizes.  XOR-hashing every shingle into one cell of a sketch makes the number of
differing cells, and of differing bits, a lower bound of that difference.

1. Documents with one and the same set become one class.
2. Size bands grow by 1 / threshold, so two linked sets are in the same band or
   in neighbouring ones; a set writes the keys of its own band and the next.  A
   band's sketch has more cells than the largest difference ``d`` allowed in
   it, so by the pigeonhole principle linked sets share a cell that is equal
   and not empty as long as one of them has more than ``d`` cells in use.
   Cells leave out *frequent* shingles (common passages, from a sample of
   documents); a set left with too few cells also writes cells of all its
   shingles, and if even those are too few, every shingle as a key.  Which
   shingles count as frequent changes the number of candidates, never a result.
3. Keys are 48-bit numbers, packed in binary blocks by hash range, sorted with
   numpy after one shuffle.  Sets that share a key are candidates: all pairs
   while at most ``GROUP`` sets share it, else each with the smallest one.
4. Candidates whose bit sketches differ in too many bits go (exact bound); the
   others are verified on their shingles.
5. Verified links give components.  Keys shared by more than ``GROUP`` sets of
   components are searched for further links across the components against the
   bit sketches, in groups that one task holds; what passes is verified too, and
   the components are joined.  So no link between components is lost, and a
   group of thousands of near copies costs one candidate per member and key.
   The sets of a key that more than ``HELD`` share meet in other groups: by
   their shingles that at most ``HELD`` of these sets have, and, where two sets
   can link by more common shingles alone, in pairs of hashed blocks.

Hashes of 64 bits stand for shingles and sets.

Edge cases: null and empty texts have no set, ``n_shingles`` 0 and link with
nothing; a text of fewer words than a shingle has its whole sequence as its one
shingle; repeated rows and equal texts share a class; null ids take part, and
count as the largest when a component's smallest id is sought (a component of
null ids alone has a null ``component_id``).  A class's text is found again by a
hash of id and text, so ids may be null or stand on several texts;
:func:`keep_first` drops rows by id and that hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import ascii_lower_bytes, chunks, id_and_text, join_ids, materialise, release_memory, sample_rows, small_batches
from tablework.llm.components import connected_components
from tablework.llm.shingles import BASE, Words, mix, shingle_sets

SHINGLE = 5
PERCENT = 75
GROUP = 24
#: Sets of one key, shingle or block that a task compares with each other.
HELD = 2048
#: Earlier keys of a set that a task sees beside each of its keys.
PRIOR = 8
#: Documents whose shingles are looked at for common ones, and in how many of
#: their sets a shingle must be to count as frequent.
FREQUENT_SAMPLE, FREQUENT_IN = 4096, 3
FREQUENT_BITS = 22
SPARE = 0.08  # cells beyond the least number, as a share of the set
#: Of a Python task: texts hashed at once (their words take about 60 times
#: that), keys held before they are packed, and sets known to be packed.
SLICE_BYTES = 1 << 19
BLOCK_BYTES = 3 << 20
SEEN_SETS = 1 << 16
PARTITION_BYTES = 6 << 20
KEY_MASK = np.uint64((1 << 48) - 1)

EMITTED = "bucket int, kind int, doc_id long, row long, n long, set_id long, sketch binary, keys binary"
MATCHED = "kind int, doc_id long, row long, n long, set_id long, other long, sketch binary"


def band_edges(percent: int = PERCENT, top: int = 1 << 40) -> np.ndarray:
    """Smallest sizes of the bands: sets similar enough lie in one band or in
    two neighbouring ones."""
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return np.array(edges, np.int64)


def max_difference(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


class Sketcher:
    """Keys and bit sketches of a slice's shingle sets."""

    def __init__(self, frequent: np.ndarray, percent: int):
        self.edges, self.percent = band_edges(percent), percent
        self.frequent = np.zeros(1 << FREQUENT_BITS, bool)
        self.frequent[frequent] = True

    def _cells(self, doc: np.ndarray, token: np.ndarray, cells: np.ndarray, band: np.ndarray, scheme: int) -> tuple[np.ndarray, np.ndarray]:
        """(set number, key) of the used cells."""
        base = np.concatenate(([0], np.cumsum(cells)))
        at = base[doc] + ((token >> np.uint64(16)) % cells[doc].astype(np.uint64)).astype(np.int64)
        value = np.zeros(base[-1], np.uint64)
        np.bitwise_xor.at(value, at, token)
        used = np.flatnonzero(np.bincount(at, minlength=base[-1]))
        owner = np.searchsorted(base, used, "right") - 1
        return owner, mix(value[used] * BASE + mix(((used - base[owner]) + (band[owner] << 40) + (scheme << 56)).astype(np.uint64)))

    def keys(self, doc: np.ndarray, token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.searchsorted(self.edges, size, "right") - 1
        rare = ~self.frequent[(token >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for step in (0, 1):
            band = own + step
            largest = self.edges[band + 1] - 1
            d = max_difference(largest, largest, self.percent)
            cells = d + 2 + (SPARE * largest).astype(np.int64) + 8
            live = d > 0  # else only equal sets link, and they are one class
            todo, mask = live, rare
            for scheme in (1, 2):
                pick = todo[doc] & mask
                owner, key = self._cells(doc[pick], token[pick], cells, band, scheme)
                keep = todo[owner]
                out.append((owner[keep], key[keep]))
                todo = todo & (np.bincount(owner, minlength=len(size)) <= d)
                mask = np.ones(len(token), bool)
            pick = todo[doc]
            out.append((doc[pick], mix(token[pick] ^ mix((band[doc[pick]] + (3 << 56)).astype(np.uint64)))))
        owner, key = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(owner, kind="stable")
        return owner[order], key[order]

    @staticmethod
    def bits(token: np.ndarray) -> bytes:
        """Parity of the shingles by bit; a power of two of about two bits a
        shingle, so that a longer sketch folds onto a shorter one."""
        n = max(64, 1 << int(2 * len(token) - 1).bit_length())
        parity = np.bincount((token & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
        return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, n: int) -> np.ndarray:
    while len(sketch) > n:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def bit_difference(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, n) ^ fold(y, n)).sum())


def _sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, token = shingle_sets(Words([ascii_lower_bytes(t) for t in texts]), n)
    size = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    # a set's number: sums of two mixes of its shingles
    a = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token), dtype=np.uint64)))
    b = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token ^ BASE), dtype=np.uint64)))
    set_id = mix((a[first[1:]] - a[first[:-1]]) * BASE + mix((b[first[1:]] - b[first[:-1]]) + size.astype(np.uint64))).astype(np.int64)
    return doc, token, size, set_id


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Hash prefixes of shingles common in a bounded sample of documents."""
    shift = np.uint64(64 - FREQUENT_BITS)
    sample = sample_rows(docs.select("doc_id", "text"), FREQUENT_SAMPLE)

    def run(batches):
        for _, texts in chunks(batches, max_bytes=SLICE_BYTES):
            doc, token, _, set_id = _sets(texts, n)
            yield pa.RecordBatch.from_pydict({"set_id": pa.array(set_id[doc], pa.int64()), "p": pa.array((token >> shift).astype(np.int32), pa.int32())})

    found = sample.mapInArrow(run, "set_id long, p int").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT_IN)
    return np.array([r.p for r in found.select("p").collect()], np.int64)  # at most 2^FREQUENT_BITS


def _emit(frequent: np.ndarray, n: int, percent: int, buckets: int):
    names = [f.split()[0] for f in EMITTED.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def blocks(held: list[tuple]) -> pa.RecordBatch:
        key = np.concatenate([h[0] for h in held])
        runs = [np.concatenate([h[k] for h in held]) for k in (1, 2, 3)]  # set, size, number of keys
        owner = np.repeat(np.arange(len(runs[0])), runs[2])
        bucket = (key >> np.uint64(48)).astype(np.int64) * buckets >> 16
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        key, owner = key[order], owner[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(ends)):
            part, own = key[ends[b] : ends[b + 1]] & KEY_MASK, owner[ends[b] : ends[b + 1]]
            who, count = np.unique(own, return_counts=True)
            packed = part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            head = np.array([len(who)], "<i8").tobytes() + runs[0][who].tobytes() + runs[1][who].tobytes() + count.astype("<i8").tobytes()
            rows.append((int(b), head + packed))
        m = len(rows)
        none = [None] * m
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[r[0] for r in rows], [1] * m, none, none, none, none, none, [r[1] for r in rows]], types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(frequent, percent)
        held, size_held, seen = [], 0, set()
        for part, texts in chunks(batches, max_bytes=SLICE_BYTES):
            doc, token, size, set_id = _sets(texts, n)
            first = np.concatenate(([0], np.cumsum(size)))
            new = np.array([bool(c) and (s not in seen) and not seen.add(s) for s, c in zip(set_id.tolist(), size.tolist(), strict=True)], bool)
            sketch = [Sketcher.bits(token[first[i] : first[i + 1]]) if new[i] else None for i in range(len(texts))]
            m = len(texts)
            bucket = (set_id.astype(np.uint64) >> np.uint64(48)).astype(np.int64) * buckets >> 16
            facts = [bucket.astype(np.int32), [0] * m, part.column("doc_id"), part.column("row"), size, [int(s) if c else None for s, c in zip(set_id, size, strict=True)], sketch, [None] * m]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(facts, types, strict=True)], schema=schema)
            pick = new[doc]
            if pick.any():
                number = np.cumsum(new) - 1
                owner, key = sketcher.keys(number[doc[pick]], token[pick], size[new])
                held.append((key, set_id[new], size[new], np.bincount(owner, minlength=int(new.sum()))))
                size_held += 8 * len(key)
            if size_held >= BLOCK_BYTES:
                yield blocks(held)
                held, size_held = [], 0
                if len(seen) > SEEN_SETS:
                    seen = set()
        if held:
            yield blocks(held)
            held = []
        release_memory()

    return run


def _shared(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, size) of the entries whose key stands in ``blocks`` more than
    once.  Most keys stand there once; those never get a set and a size."""
    sets = [int(np.frombuffer(b, "<i8", 1)[0]) for b in blocks]
    who, size, count = (np.concatenate([np.frombuffer(b, "<i8", m, 8 + 8 * m * k) for b, m in zip(blocks, sets, strict=True)]) for k in range(3))
    ends = np.cumsum(count)
    key, at = np.zeros(int(ends[-1]), "<u8"), 0
    for b, m in zip(blocks, sets, strict=True):
        raw = np.frombuffer(b, np.uint8, offset=8 + 24 * m).reshape(-1, 6)
        key[at : at + len(raw)].view(np.uint8).reshape(-1, 8)[:, :6] = raw
        at += len(raw)
    order = np.argsort(key)
    key = key[order]
    again = np.zeros(len(key), bool)
    np.equal(key[1:], key[:-1], out=again[1:])
    again[:-1] |= again[1:]
    owner = np.searchsorted(ends, order[again], "right")
    return key[again], who[owner], size[owner]


def group_pairs(key: np.ndarray, who: np.ndarray, size: np.ndarray, percent: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (smaller set id first), and (key, set) of the keys that
    more than ``group`` sets share."""
    order = np.lexsort((who, key))
    key, who, size = key[order], who[order], size[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    key, who, size = key[fresh], who[fresh], size[fresh]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((start, [len(key)])))
    pairs = []
    for g in np.unique(count[(count > 1) & (count <= group)]):
        at = start[count == g]
        for i in range(g):
            for j in range(i + 1, g):
                pairs.append(np.stack((at + i, at + j)))
    big = np.flatnonzero(count > group)
    members = np.concatenate([np.arange(start[b], start[b] + count[b]) for b in big]) if len(big) else np.zeros(0, np.int64)
    pairs.append(np.stack((np.repeat(start[big], count[big]), members)))
    left, right = np.concatenate(pairs, axis=1)
    ok = (left != right) & (100 * np.minimum(size[left], size[right]) >= percent * np.maximum(size[left], size[right]))
    both = np.unique(np.stack((who[left[ok]], who[right[ok]]), axis=1), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
    return both, key[members], who[members]


def _match(percent: int, group: int):
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip([f.split()[0] for f in MATCHED.split(", ")], types, strict=True)))

    def rows(kind: int, **columns) -> pa.RecordBatch:
        n = len(columns["set_id"])
        data = {"kind": pa.array(np.full(n, kind), pa.int32())} | columns
        return pa.RecordBatch.from_arrays([pa.array(data[f.name], f.type) if f.name in data and not isinstance(data[f.name], pa.Array) else data.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            is_fact = pa.compute.equal(batch.column("kind"), 0)
            facts = batch.filter(is_fact)
            if facts.num_rows:
                yield rows(0, **{c: facts.column(c) for c in ("doc_id", "row", "n", "set_id", "sketch")})
            blocks = batch.filter(pa.compute.invert(is_fact))
            for bucket, block in zip(blocks.column("bucket").to_pylist(), blocks.column("keys").to_pylist(), strict=True):
                held.setdefault(bucket, []).append(block)
        for bucket in sorted(held):
            pairs, big_key, big_who = group_pairs(*_shared(held.pop(bucket)), percent, group)
            if len(pairs):
                yield rows(1, set_id=pairs[:, 0], other=pairs[:, 1])
            if len(big_key):
                yield rows(2, set_id=big_who, other=(big_key + (np.uint64(bucket) << np.uint64(48))).astype(np.int64))
        release_memory()

    return run


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bit sketches do not rule a link out."""
    info = classes.select("set_id", "n", "sketch")
    side = lambda s: info.select(F.col("set_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    wide = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for x in batches:
            limit = max_difference(np.asarray(x.column("n_a")), np.asarray(x.column("n_b")), percent).tolist()
            keep = [bit_difference(p, q) <= m for p, q, m in zip(x.column("sketch_a").to_pylist(), x.column("sketch_b").to_pylist(), limit, strict=True)]
            yield x.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return materialise(wide.mapInArrow(run, "a long, b long"), "near-pairs")


def _shingles(ids: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(set_id, tokens): the whole sets of the distinct ``ids``, from their texts."""
    # one row of the class has the text; rows whose hashes are equal by chance are told apart by the set
    wanted = materialise(ids.join(classes.select("set_id", "row"), "set_id"), "wanted-sets")
    texts = join_ids(docs, materialise(wanted.select("row").distinct(), "wanted-rows"), column="row")

    def run(batches):
        for _, part in chunks(batches, max_bytes=SLICE_BYTES):
            _, token, size, set_id = _sets(part, n)
            first = np.concatenate(([0], np.cumsum(size)))
            yield pa.RecordBatch.from_pydict({"set_id": pa.array(set_id, pa.int64()), "tokens": pa.array([token[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())})

    sets = texts.mapInArrow(run, "set_id long, tokens binary").join(wanted.select("set_id"), "set_id", "left_semi")
    return materialise(sets.dropDuplicates(["set_id"]), "shingle-sets")


def _verified(near: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole shingle sets."""
    ids = near.select(F.col("a").alias("set_id")).union(near.select("b")).distinct()
    sets = _shingles(ids, classes, docs, n)
    side = lambda s: sets.select(F.col("set_id").alias(s), F.col("tokens").alias(f"tokens_{s}"))
    wide = near.join(side("a"), "a").join(side("b"), "b")

    def check(batches):
        for x in batches:
            keep = []
            for p, q in zip(x.column("tokens_a"), x.column("tokens_b"), strict=True):
                left, right = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                same = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * same >= percent * (len(left) + len(right) - same))
            yield x.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return materialise(wide.mapInArrow(check, "a long, b long"), "links")


def _by_shingle(sets: DataFrame, classes: DataFrame, docs: DataFrame, n: int, held: int) -> tuple[DataFrame, DataFrame]:
    """Of ``sets`` (set_id, label): (g, set_id) by each shingle that 2 to
    ``held`` sets of several components have, and (set_id, common), the number
    of shingles that more have."""

    def each(batches):
        for x in batches:
            tokens = [np.frombuffer(t.as_buffer(), np.int64) for t in x.column("tokens")]
            for ids, part in zip(x.column("set_id").to_pylist(), tokens, strict=True):
                yield pa.RecordBatch.from_pydict({"set_id": pa.array(np.full(len(part), ids), pa.int64()), "token": pa.array(part, pa.int64())})

    tokens = materialise(_shingles(sets.select("set_id"), classes, docs, n).mapInArrow(each, "set_id long, token long").join(sets, "set_id"), "open-shingles")
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    counted = materialise(counted.where("c > 1 and lo < hi").select("token", "c"), "shingle-counts")
    rare = join_ids(tokens, counted.where(F.col("c") <= held).select("token"), column="token")
    common = join_ids(tokens, counted.where(F.col("c") > held).select("token"), column="token")
    return rare.select(F.xxhash64(F.lit("shingle"), "token").alias("g"), "set_id"), common.groupBy("set_id").agg(F.count(F.lit(1)).alias("common"))


def _by_block(near: DataFrame, held: int) -> DataFrame:
    """(g, set_id): pairs of blocks of about ``held`` members of a key, as far as
    two of their members can be a strong one and one of another component."""
    sizes = near.groupBy("key", "strong", "label").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.select("key", "strong", "label", F.when(F.col("m") > held, F.col("label")).alias("one"), "m")
    rooms = sizes.groupBy("key", "strong", "one").agg(F.ceil(F.sum("m") / held).alias("rooms"))
    large = sizes.where("one is not null").select("key", "strong", "label", "one")
    placed = near.join(large, ["key", "strong", "label"], "left").alias("p").join(
        rooms.alias("r"), F.expr("p.key = r.key and p.strong = r.strong and p.one <=> r.one")
    )
    block = F.xxhash64("p.strong", "p.one", F.pmod(F.xxhash64("set_id"), F.col("rooms")))
    placed = materialise(placed.select("p.key", "p.strong", "p.one", "set_id", block.alias("block")), "blocks")
    blocks = placed.select("key", "strong", "one", "block").distinct()
    pairs = blocks.alias("x").join(blocks.alias("y"), F.expr("x.key = y.key and x.block <= y.block and (x.strong or y.strong) and not coalesce(x.one = y.one, false)"))
    pairs = pairs.select("x.key", F.col("x.block").alias("x"), F.col("y.block").alias("y"), F.xxhash64(F.lit("block"), "x.key", "x.block", "y.block").alias("g"))
    side = lambda c: placed.select("key", F.col("block").alias(c), "set_id").join(pairs, ["key", c]).select("g", "set_id")
    return side("x").unionByName(side("y")).distinct()


def _open_groups(entries: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, held: int) -> DataFrame:
    """Sets by group ``g``, so that any two sets that link, share a large key and
    are in different components are in one group; a group has about twice
    ``held`` sets at most.  ``prior``: the few groups of a set before this one,
    in the order of their numbers, or null."""
    labelled = entries.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("key", "c")
    inside = materialise(labelled.join(open_keys, "key"), "open-keys")
    facts = classes.select("set_id", "n", "sketch")
    few, many = inside.where(F.col("c") <= held), inside.where(F.col("c") > held)
    # a pair that also shares one of the keys just before is reported there, or earlier still: pairs
    # that share most of their keys, as near ones do, are reported about once
    before = Window.partitionBy("set_id").orderBy("key").rowsBetween(-PRIOR, -1)
    rows = few.select("set_id", "key", "label", F.collect_list("key").over(before).alias("prior"))
    rows = rows.join(facts, "set_id").select(F.col("key").alias("g"), "set_id", "label", "n", "sketch", "prior")
    if many.isEmpty():
        return rows
    sets = materialise(many.select("set_id", "label").distinct(), "open-sets")
    rare, common = _by_shingle(sets, classes, docs, n, held)
    # linked sets a, b (n_a <= n_b) without a rare shingle in common share at least
    # percent / (100 + percent) of n_a + n_b common ones: 2 such shares of n_a, and percent of n_b
    able = common.join(facts.select("set_id", "n"), "set_id").where(100 * F.col("common") >= percent * F.col("n"))
    able = able.select("set_id", (F.col("common") * (100 + percent) >= 2 * percent * F.col("n")).alias("strong"))
    blocks = _by_block(materialise(many.select("key", "set_id", "label").join(able, "set_id"), "able-sets"), held)
    more = rare.unionByName(blocks).join(sets, "set_id").join(facts, "set_id")
    return rows.unionByName(more.select("g", "set_id", "label", "n", "sketch", F.lit(None).cast("array<bigint>").alias("prior")))


def _across(entries: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, held: int, block: int = 512) -> DataFrame:
    """Pairs (a, b) of sets that share a large key, are in different components
    and are near by their bit sketches."""
    rows = _open_groups(entries, labels, classes, docs, n, percent, held)

    def groups(batches):
        held, key = [], None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("g", "set_id", "label", "n", "sketch", "prior")), strict=True):
                if row[0] != key:
                    if held:
                        yield key, held
                    held, key = [], row[0]
                held.append(row[1:])
        if held:
            yield key, held

    def run(batches):
        for _, members in groups(batches):
            # by size, so that only sets of similar size are compared; sketches of one length are compared in blocks
            members.sort(key=lambda m: (m[2], m[0]))
            ids, label, n = (np.array([m[k] for m in members], np.int64) for k in range(3))
            words = min(len(m[3]) for m in members) // 8
            by_length: dict[int, np.ndarray] = {}
            for w in sorted({max(words, len(m[3]) // 8) for m in members}):
                fit = [i for i, m in enumerate(members) if len(m[3]) // 8 >= w]
                by_length[w] = np.full((len(members), w), 0, np.uint64)
                for i in fit:
                    by_length[w][i] = fold(np.frombuffer(members[i][3], np.uint64), w)
            found, keys = [], [frozenset(m[4]) if m[4] is not None else None for m in members]
            for i in range(len(members)):
                w = len(members[i][3]) // 8
                stop = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
                for at in range(i + 1, stop, block):
                    to = min(at + block, stop)
                    apart = np.bitwise_count(by_length[w][at:to] ^ by_length[w][i]).sum(axis=1)
                    ok = (label[at:to] != label[i]) & (apart <= max_difference(n[i], n[at:to], percent))
                    for j in at + np.flatnonzero(ok):
                        if keys[i] is None or keys[i].isdisjoint(keys[j]):
                            found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def _components(docs: DataFrame, n: int, percent: int, group: int, id_col: str, text_col: str, held: int) -> DataFrame:
    """Per row of ``docs``: doc_id, row, n_shingles, set_id (null without a
    set), label (a set of the component) and component_id."""
    with small_batches(docs.sparkSession):
        source = id_and_text(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
        size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(1, -(-size // PARTITION_BYTES))
        buckets = min(partitions, 1 << 16)
        emitted = source.mapInArrow(_emit(_frequent(source, n), n, percent, buckets), EMITTED)
        matched = materialise(emitted.repartition(partitions, "bucket").mapInArrow(_match(percent, group), MATCHED), "matched")
        facts = matched.where("kind = 0").select("doc_id", "row", "n", "set_id", "sketch")
        classes = facts.where("set_id is not null").groupBy("set_id").agg(
            F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.max("n").alias("n"), F.max("sketch").alias("sketch")
        )
        classes = materialise(classes, "classes")
        pairs = matched.where("kind = 1").select(F.col("set_id").alias("a"), F.col("other").alias("b"))
        links = _verified(_near(pairs, classes, percent), classes, source, n, percent)
        labels = connected_components(links)
        entries = matched.where("kind = 2").select("set_id", F.col("other").alias("key"))
        more = _near(_across(entries, labels, classes, source, n, percent, held), classes, percent)
        if not more.isEmpty():
            links = links.unionByName(_verified(more, classes, source, n, percent))
            labels = connected_components(links)
        named = classes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = materialise(named.join(smallest, "label").select("set_id", "label", "component_id"), "components")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    joined = facts.drop("sketch").join(named, "set_id", "left")
    return joined.select("doc_id", "row", F.col("n").alias("n_shingles"), "set_id", "label", component.alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, set_id (null without a
    set) and component_id, the smallest doc_id reachable by links."""
    return _components(docs, n, percent, group, id_col, text_col, held).select("doc_id", "n_shingles", "set_id", "component_id")


def keep_first(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null
    is the largest), of equal ids that of the smallest hash of id and text; of
    rows equal in both any one.  Rows without a set all stay."""
    found = materialise(_components(docs, n, percent, GROUP, "doc_id", "text", HELD).where("set_id is not null").select("doc_id", "row", "label"), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = found.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    marked = found.join(first.select("label", "first"), "label").withColumn("stays", order == F.col("first"))
    key = [F.col("doc_id").isNull().alias("__no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("__id"), F.col("row").alias("__row")]
    names = ["__no_id", "__id", "__row"]
    dropped = materialise(marked.where("NOT stays").select(*key).distinct(), "near-copies")
    twice = materialise(marked.where("stays").groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*names), "equal-rows")
    own = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"__no_id": own.isNull(), "__id": F.coalesce(own, F.lit(0).cast("long")), "__row": F.xxhash64(own, F.coalesce("text", F.lit("")))})
    kept = join_ids(keyed, dropped, "left_anti", names)
    if not twice.isEmpty():
        kept = join_ids(kept, twice, "left_anti", names).unionByName(join_ids(kept, twice, "left_semi", names).dropDuplicates(names))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

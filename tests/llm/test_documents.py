"""The document operators against brute force on the awkward fixture."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablework.llm import byte_bpe, content_sort, packing, parity_join, queries, repetition, secret_scan, substrings
from tablework.llm.components import connected_components
import fixture as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.frame(spark).cache()


@pytest.fixture(scope="module")
def pairs():
    return [r[:2] for r in fx.rows()]


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# --- exact dedup ---------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_content_sort(docs, pairs, ranges):
    got = content_sort.dedup_exact(docs, ranges).collect()
    groups = fx.exact_groups(pairs)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, top[fx.lowered(t)], len(groups[fx.lowered(t)]), hashlib.sha256(fx.lowered(t).encode()).hexdigest()) for i, t in pairs]
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_content_sort_keeps_all_columns(docs, pairs):
    got = content_sort.keep_one(docs)
    assert got.columns == docs.columns
    assert got.count() == len(fx.exact_groups(pairs))


def test_content_sort_hot_group_over_many_ranges(spark):
    data = [(i, "same text" if i % 3 else f"text {i}") for i in range(600)]
    got = content_sort.dedup_exact(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 16).collect()
    sizes = {(r.keep_id, r.group_size) for r in got if r.group_size > 1}
    assert sizes == {(599, 400)}
    assert sum(r.kept for r in got) == 201


def test_content_sort_runs_without_python(docs):
    plan = content_sort.dedup_exact(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


# --- packing -------------------------------------------------------------


def ids_by_tokenizer(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [e.ids + [packing.END_ID] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_places_every_id_once(docs, pairs):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    want = Counter()
    for (i, _), ids in zip(pairs, ids_by_tokenizer([t for _, t in pairs]), strict=True):
        for at in range(0, len(ids), 2048):
            raw = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[i, at, len(raw) // 4, zlib.crc32(raw), len(ids), raw] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))


def test_sequences_are_padded_unless_a_power_of_two(spark):
    data = [(1, "a b c"), (2, "a b"), (3, "x " * 2047)]
    packed = packing.pack(spark.createDataFrame(data, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 2048)


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_cutting_stock_uses_every_piece_and_comes_near_the_bound(n):
    rng = np.random.default_rng(n)
    sizes, counts = np.unique(np.minimum(256, rng.lognormal(4, 1, n).astype(int) + 1), return_counts=True)
    plan = packing.cutting_stock(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), 256)
    placed = Counter()
    for pattern, times in plan:
        assert sum(s * c for s, c in pattern.items()) <= 256
        for s, c in pattern.items():
            placed[s] += c * times
    assert placed == dict(zip(sizes, counts, strict=True))
    assert sum(t for _, t in plan) <= -(-int((sizes * counts).sum()) // 256) + 3


# --- substring dedup -----------------------------------------------------


def test_substring_dedup(docs, pairs):
    got = substrings.remove_repeats(docs).collect()
    want = fx.without_repeats([t for _, t in pairs])
    same([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got], [(i, *w) for (i, _), w in zip(pairs, want, strict=True)])
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_substring_dedup_short_windows_and_overlaps(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=6).collect()
    want = fx.without_repeats(texts, 6)
    same([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got], [(i, *w) for i, w in enumerate(want)])


def test_suffix_automaton_matches_plain_search():
    import random

    rng = random.Random(5)
    passages = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(4, 30))] for _ in range(8)]
    automaton = substrings.SuffixAutomaton()
    begins = [automaton.add(p) for p in passages]
    known = {tuple(p[i : i + 4]) for p in passages for i in range(len(p) - 3)}
    flat = [w for p in passages for w in p]
    for _ in range(50):
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        at, there = automaton.ends(text, 4)
        assert at == [i for i in range(3, 25) if tuple(text[i - 3 : i + 1]) in known]
        assert all(tuple(flat[e - 3 : e + 1]) == tuple(text[i - 3 : i + 1]) for i, e in zip(at, there, strict=True))
    assert begins[0] == 0


# --- n-gram join ---------------------------------------------------------


@pytest.mark.parametrize("group", [2, 24])
def test_parity_join(docs, pairs, group):
    known = [(i, t) for i, t in pairs]
    got = parity_join.near_duplicates(docs, group=group).collect()
    number = fx.components(known)
    smallest = {}
    for (i, _), c in zip(known, number, strict=True):
        smallest[c] = i if c not in smallest or smallest[c] is None else min(smallest[c], i if i is not None else smallest[c])
    want = [(i, len(fx.shingle_set(t)), smallest[c] if fx.shingle_set(t) else i) for (i, t), c in zip(known, number, strict=True)]
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], want)


def test_parity_join_random_sets(spark):
    import random

    rng = random.Random(11)
    texts = []
    for size in (3, 4, 5, 7, 9, 12, 17, 30, 55):
        base = [rng.choice("abcdefghijklmnop") for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice("abcdefghijklmnop")] * rng.randint(0, 2)
            texts.append(" ".join(w))
    data = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), group=3).collect()}
    assert got == {i: c if fx.shingle_set(t) else i for (i, t), c in zip(data, fx.components(data), strict=True)}


def key_block(sets: list[tuple[int, int, list[int]]]) -> bytes:
    """A block of (set, size, 48-bit keys), as the join packs them."""
    head = [np.array(x, "<i8").tobytes() for x in ([len(sets)], [s for s, _, _ in sets], [n for _, n, _ in sets], [len(k) for _, _, k in sets])]
    return b"".join([*head, *(int(x).to_bytes(6, "little") for _, _, k in sets for x in k)])


def test_only_shared_keys_get_a_set_and_a_size():
    rng = np.random.default_rng(3)
    sets = [(int(s), 20 + s % 7, rng.integers(0, 400, 9).tolist()) for s in range(-30, 30)]
    sets += sets[:2]  # a set from two tasks
    entries = [(k, s, n) for s, n, keys in sets for k in keys]
    often = {k for k, _, _ in entries if sum(k == x for x, _, _ in entries) > 1}
    for cut in (1, 17, len(sets)):
        got = parity_join._shared([key_block(part) for part in (sets[:cut], sets[cut:]) if part])
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(e for e in entries if e[0] in often)
        assert got[0].tolist() == sorted(got[0].tolist())
    assert [len(x) for x in parity_join._shared([key_block([(1, 2, [5])])])] == [0, 0, 0]


def test_a_match_task_holds_little_beside_its_keys():
    import tracemalloc

    import pyarrow as pa

    m, each = 4000, 200  # no key is shared, but for the last set's, which are the first one's
    keys = np.random.default_rng(5).permutation(m * each).reshape(m, each)
    keys[-1] = keys[0]
    head = [np.array([m], "<i8"), np.arange(m, dtype="<i8"), np.full(m, 300, "<i8"), np.full(m, each, "<i8")]
    block = b"".join(x.tobytes() for x in head) + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    names = [f.split()[0] for f in parity_join.EMITTED.split(", ")]
    row = {"bucket": pa.array([0], pa.int32()), "kind": pa.array([1], pa.int32()), "keys": pa.array([block], pa.binary())}
    batch = pa.RecordBatch.from_pydict({c: row.get(c, pa.nulls(1, pa.binary() if c == "sketch" else pa.int64())) for c in names})
    tracemalloc.start()
    try:
        out = [r for b in parity_join._match(75, 24)(iter([batch])) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(r["kind"], r["set_id"], r["other"]) for r in out] == [(1, 0, m - 1)]
    assert peak < 8 * len(block)


def boilerplate_pages() -> list[tuple]:
    """Pages of 80 % and of 92 % common text, some of them near copies of each other."""
    import random

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common, texts = [[word() for _ in range(k)] for k in (160, 230)], []
    for text, own in ((0, 40), (1, 20)):
        for k in range(70):
            body = common[text] + [word() for _ in range(own)]
            texts.append(" ".join(body))
            if k % 10 == 0:
                body[-3] = word()
                texts.append(" ".join(body))
            if text and k % 2:  # two places more, so that these link with few of the others
                body[20:20], body[90:90] = [word() for _ in range(18)], [word() for _ in range(18)]
                texts.append(" ".join(body))
    return list(enumerate(texts))


@pytest.mark.parametrize("held", [8, 2048])
def test_boilerplate_pages_link_as_by_brute_force(spark, held):
    data = boilerplate_pages()
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), group=3, held=held).collect()}
    assert got == dict(zip(range(len(data)), fx.components(data), strict=True))


def test_groups_of_a_large_key_are_bounded_and_lose_no_link(spark):
    data, held = boilerplate_pages(), 16
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "doc_id AS row")
    _, token, size, set_id = parity_join._sets([t.encode() for _, t in data], 5)
    first = np.concatenate(([0], np.cumsum(size)))
    tokens = {int(s): token[first[i] : first[i + 1]] for i, s in enumerate(set_id)}
    classes = spark.createDataFrame([(int(s), i, int(size[i]), parity_join.Sketcher.bits(tokens[int(s)])) for i, s in enumerate(set_id)], "set_id long, row long, n long, sketch binary")
    entries = classes.selectExpr("set_id", "7L as key")
    labels = spark.createDataFrame([], "node long, label long")  # nothing is linked yet
    groups = {}
    for r in parity_join._open_groups(entries, labels, classes, docs, 5, 75, held).collect():
        groups.setdefault(r.g, set()).add(r.set_id)
    assert max(map(len, groups.values())) <= 4 * held < len(data) / 2
    found = {(r.a, r.b) for r in parity_join._across(entries, labels, classes, docs, 5, 75, held).collect()}
    ids = sorted(tokens)
    links = set()
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            same = len(np.intersect1d(tokens[x], tokens[y]))
            if 100 * same >= 75 * (len(tokens[x]) + len(tokens[y]) - same):
                links.add((x, y))
    assert len(links) > 100 and links <= found


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, extra in ((3, 1), (50, 9), (400, 200)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[extra:], rng.integers(0, 1 << 63, 3 * extra).astype(np.uint64)))
        assert parity_join.bit_difference(parity_join.Sketcher.bits(a), parity_join.Sketcher.bits(b)) <= 4 * extra


def test_bands_hold_linked_sizes():
    edges = parity_join.band_edges()[:60]
    for b in range(1, 5000):
        for a in (-(-75 * b // 100), b):
            if 100 * a >= 75 * b:
                assert np.searchsorted(edges, b, "right") - np.searchsorted(edges, a, "right") <= 1


def test_keep_first(docs, pairs):
    got = parity_join.keep_first(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.select("doc_id").collect()}
    assert {0, 1, 2, 3} <= kept and 900 not in kept


def test_null_and_shared_ids_lose_no_link_and_no_text(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(base[:50] + [f"x{k}y{i}" for i in range(k)] + base[50:])
    other = " ".join(f"o{i}" for i in range(40))
    # a chain: the ends differ too much, the middle has no id
    ends = [" ".join(base[i : i + 52]) for i in (0, 4, 8)]
    data = [(5, ends[0]), (None, ends[1]), (7, ends[2]), (None, "far away " + other)]
    schema = "doc_id long, text string"
    got = {(r.doc_id, r.n_shingles): r.component_id for r in parity_join.near_duplicates(spark.createDataFrame(data, schema)).collect()}
    assert got == {(5, 48): 5, (None, 48): 5, (7, 48): 5, (None, 38): None}
    kept = lambda rows: sorted(map(tuple, parity_join.keep_first(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=key)
    assert kept(data) == sorted([data[0], data[3]], key=key)
    # one id on two texts: only the one that is a near copy goes
    rows = [(1, near(1)), (2, near(2)), (2, other)]
    assert kept(rows) == sorted([rows[0], rows[2]], key=key)
    # rows without ids: one of each group stays; equal rows count once
    rows = [(None, near(1)), (None, near(2)), (None, other), (None, other), (3, ""), (3, ""), (None, None)]
    assert [r[1] for r in kept(rows) if r[1]].count(other) == 1
    assert len(kept(rows)) == 5
    assert [r[0] for r in kept([(4, near(1)), (None, near(2))])] == [4]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {150: 150, 200: 150}


# --- repetition ----------------------------------------------------------


def test_repetition_base_counts(docs, pairs):
    def brute(text):
        text = text or ""
        w = text.encode().split()
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = set()
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                inside |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed

    got = repetition.repetition_quality(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(i, *brute(t)) for i, t in pairs])
    assert not any(r.kept for r in got if r.base_failed)


def test_repetition_coverage(spark):
    import random

    rng = random.Random(2)
    prose = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    ten = prose(10)
    data = [(1, prose(300)), (2, prose(150) + " " + " ".join([ten, prose(3)] * 9)), (3, "\n".join([prose(10)] + [ten] * 9 + [prose(200)]))]
    got = {r.doc_id: r for r in repetition.repetition_quality(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept
    assert got[1].dup_ngram_char_share == [0.0] * 6
    assert got[3].dup_line_share == pytest.approx(8 / 11)


# --- byte-level BPE ------------------------------------------------------

RANKS = "byte_bpe_multi_50k.tiktoken"


def test_byte_bpe_round_trip(docs, pairs):
    import tiktoken

    path = public_tokenizers.path(RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN).cache()
    want = [(i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs]
    same([(r.doc_id, bytes(r.ids), r.decoded_sha256) for r in encoded.collect()], want)
    same([(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded, path).collect()], [(i, (t or "").encode()) for i, t in pairs])


def test_op8_gets_batches_of_few_bytes(spark, tmp_path, monkeypatch):
    def watched(make):
        def made(*args):
            step = make(*args)

            def run(batches):
                def small():
                    for b in batches:
                        assert b.nbytes < 8 << 20
                        yield b

                return step(small())

            return run

        return made

    monkeypatch.setattr(byte_bpe, "_split", watched(byte_bpe._split))
    monkeypatch.setattr(byte_bpe, "_assemble", watched(byte_bpe._assemble))
    spark.range(40).selectExpr("id AS doc_id", "repeat('some words ', 60000) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    try:
        got = queries.op8_byte_bpe(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    whole = hashlib.sha256(b"some words " * 60000).hexdigest()
    assert sorted(r.doc_id for r in got) == list(range(40)) and {r.decoded_sha256 for r in got} == {whole}


def test_heap_merges_follow_the_same_rule():
    pieces = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    number = {p: i for i, p in enumerate(pieces)}

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while (best := min(((number[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in number), default=None)) is not None:
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [number[p] for p in parts]

    for word in (b"a" * 200, b"internationalisation" * 9, ("中文" * 40).encode(), b"=-=-" * 50, b"abcabcabd" * 20):
        assert byte_bpe.heap_merges(word, number) == plain(word)


def test_splitting_of_latin_texts_follows_the_pattern():
    import random

    import regex

    rng = random.Random(6)
    plain = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
    find = byte_bpe._finder(public_tokenizers.PATTERN)
    kinds = [lambda: rng.randrange(256), lambda: rng.choice(b" '\n\tstvmreld09"), lambda: rng.randrange(128), lambda: rng.choice([0x2019, 0x4E2D, 0x2003])]
    for k in range(3000):
        text = "".join(chr(rng.choice(kinds[: 3 + k % 2])()) for _ in range(rng.randrange(40)))
        assert find(text) == plain(text)


def test_reach_leaves_out_no_piece(spark):
    """A piece is found from its head; a head of no longer piece is not followed."""
    pieces = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    rows = spark.createDataFrame(list(enumerate(pieces)), "i int, p binary").select("i", F.xxhash64(F.substring("p", 1, byte_bpe.HEAD)).alias("b")).orderBy("i").collect()
    reach = byte_bpe.Reach(pieces, [r.b for r in rows])
    most = [reach.slots[r.b & ((1 << reach.bits) - 1)] for r in rows]
    assert all(m >= min(len(p), byte_bpe.LONG_WORD) for m, p in zip(most, pieces))
    assert np.mean(np.array(reach.slots) == byte_bpe.HEAD - 1) > 0.8


# --- secrets -------------------------------------------------------------


def test_base_spans(docs, pairs):
    found = {}
    for i, t in pairs:
        text, spans = t or "", []
        for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            spans += [(m.start(), 0, m.end())] if len(m.group(1)) >= 8 else []
        for n, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 16), (r"[0-9a-f]+", 32)), 1):
            spans += [(m.start(), n, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
        found.setdefault(i, []).append(sorted(spans))
    for r in secret_scan.scan_secrets(docs).collect():
        spans = found[r.doc_id][0]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert len(r.found) == len([x for x in r.spans.split(",") if x])


def test_markov_models_tell_random_strings_from_identifiers(spark):
    import random

    rng = random.Random(4)
    identifiers = ["read_next_record_from_stream2", "customer_order_total_2024", "parse_http_header_value1", "internationalisation4all", "user_session_manager_v2"]
    prose = " ".join(identifiers + ["the record of the customer order session header value stream parse manager next total"] * 3)
    token = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))
    syllables = ["re", "con", "ta", "ner", "ses", "sion", "va", "lue", "or", "der", "pro", "file", "na", "me", "in", "dex", "co", "de", "user", "data"]
    prose += " " + " ".join("_".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) for _ in range(300))
    hexes = [f"{prose} {rng.getrandbits(160):040x} AKIA{token().upper()[:16]}" for _ in range(200)]
    secrets = [token() for _ in range(20)]
    data = list(enumerate([*hexes, *[f"see {s} here" for s in secrets], prose]))
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    caught = sum(got[200 + k].spans == "markov:4:40" for k in range(20))
    assert caught >= 18
    assert got[220].spans == ""
    masked = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert masked[220] == prose and sum(masked[200 + k] == "see [SECRET] here" for k in range(20)) == caught


def test_secrets_inside_longer_runs_are_found():
    import random

    rng = random.Random(6)
    draw = lambda n, letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(letters) for _ in range(n))
    names = ["session_cookie_value_for_user", "customer_order_total", "parse_header_record_of_the_stream", "internationalisation"]
    ratio = secret_scan.transition_logs([draw(36) for _ in range(2000)], secret_scan.RANDOM_UNIFORM) - secret_scan.transition_logs(names * 50, secret_scan.ORDINARY_UNIFORM)
    spans = lambda t: secret_scan.markov_spans(t, ratio, secret_scan.base_spans(t))
    for _ in range(20):
        name, secret, hexes = "/".join(names) + "=", draw(16), "%032x" % rng.getrandbits(128)
        assert spans(name + secret + "/" + names[0]) == [(len(name), 3, len(name) + 16)]
        tail = "Z" + draw(23)
        assert spans(hexes + tail) == [(32, 3, 56)]
        assert spans(draw(16, "0123456789")) == []
        assert spans(draw(24, "qxzjkvwbQXZJKVWB")) == [(0, 3, 24)]
    assert not any(spans(n) for n in names) and spans("/".join(names)) == []


# --- empty tables --------------------------------------------------------


def test_empty_tables(spark):
    none = fx.frame(spark, [])
    path = public_tokenizers.path("word_bpe_49k.json")
    for result in (
        content_sort.dedup_exact(none), content_sort.keep_one(none), packing.pack(none, path), substrings.remove_repeats(none), parity_join.near_duplicates(none),
        parity_join.keep_first(none), repetition.repetition_quality(none), byte_bpe.encode(none, public_tokenizers.path(RANKS), public_tokenizers.PATTERN), secret_scan.scan_secrets(none),
    ):
        assert result.count() == 0

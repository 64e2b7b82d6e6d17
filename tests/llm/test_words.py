"""Spelling variants, language identification and phrases against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import fixture as fx
from tablework.llm import language, phrases, transducer, variants

DOCS = "doc_id long, text string, lang string, key string, word string, n long, combo int, block int, side int, rid int, origin int, total long, data string, h long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", "w", 1, 2, 3, 0, 5, 6, 7, "d", 8) for i, t, lang in rows], DOCS).repartition(3)


# --- spelling variants -----------------------------------------------------


def variants_by_hand(pairs):
    seen = Counter()
    for i, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = fx.lowered(run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, words[w], len(around[w]), form[w], words.get(form[w]), root))
    return out


def variant_rows():
    rng = np.random.default_rng(3)
    letters = list("abcdeéàÿß×")
    base = ["".join(rng.choice(letters, rng.integers(6, 11))) for _ in range(60)]
    words = []
    for k, w in enumerate(base):
        words += [w] * int(rng.choice([1, 2, 25, 300]))
        for _ in range(6):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            other = w[:at] + (["", str(rng.choice(letters)), w[at] + str(rng.choice(letters))][kind]) + w[at + 1 :]
            words += [other] * int(rng.choice([1, 2, 3, 30]))
    words += ["Zebraß" * 400] * 3 + ["zebraß" * 400 + "x"] * 40 + ["listens", "silents", "enlists"] * 2
    words += ["chain" + "a" * 3] * 3 + ["chain" + "aab"] * 40 + ["chain" + "abb"] * 500
    rng.shuffle(words)
    cut = np.array_split(np.array(words, object), 40)
    rows = [(i, " ".join(c), "en") for i, c in enumerate(cut)]
    return rows + [(7, rows[7][1], "en"), (None, rows[3][1].upper(), None), (50, None, "en"), (51, "", "en"), (52, "1 2, 3", None)]


@pytest.mark.parametrize("tile", [variants.TILE, 5])
def test_spelling_variants(spark, tile):
    rows = variant_rows()
    got = variants.spelling_variants(frame(spark, rows), tile).collect()
    want = variants_by_hand([r[:2] for r in rows])
    assert len(got) == len(want) > 100 and any(r.form for r in got) and any(r.form and r.root != r.form for r in got)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want


def test_spelling_variants_of_nothing(spark):
    assert variants.spelling_variants(frame(spark, [])).count() == 0
    assert variants.spelling_variants(frame(spark, [(1, None, "en"), (2, "", None)])).count() == 0


# --- language --------------------------------------------------------------


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(n))


def language_rows():
    rng = np.random.default_rng(5)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "абвгдежз"}
    rows = [(i, speech(rng, alphabets[lang], int(rng.integers(1, 60))).title(), lang) for i, lang in enumerate(np.random.default_rng(6).choice(list(alphabets), 600))]
    odd = [(700, None, "aa"), (701, "", "bb"), (702, "12 34 !?", "cc"), (703, "²", "cc"), (None, speech(rng, "abcd", 30), "aa"), (704, speech(rng, "абвг", 20), None)]
    return rows + odd + [rows[0], (705, speech(rng, "abcd", 60000), "aa"), (706, "ab" * 90000, "aa")]


def test_language_held_out(spark):
    rows = language_rows()
    docs = frame(spark, rows)
    model = language.fit(docs, 300)
    got = language.predict(docs, model).collect()
    assert model.langs == ["aa", "bb", "cc"] and len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    tested = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [r.lang_pred == truth[r.doc_id] for r in tested]
    assert len(tested) > 100 and np.mean(right) > 0.97
    sure = [ok for r, ok in zip(tested, right, strict=True) if not r.rejected]
    assert len(sure) > 0.8 * len(tested) and np.mean(sure) >= 0.99
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True) for i in (700, 701, 702, 703))
    assert by_id[704].lang_pred == "cc" and by_id[705].lang_pred == by_id[706].lang_pred == by_id[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_is_not_learned_from_held_out_rows(spark):
    rows = [(i, "abc" if zlib.crc32(str(i).encode()) % 4 == 2 else "xyz", "held" if zlib.crc32(str(i).encode()) % 4 == 2 else "seen") for i in range(40)]
    assert language.fit(frame(spark, rows)).langs == ["seen"]
    assert {r.lang_pred for r in language.predict(frame(spark, rows), language.fit(frame(spark, rows))).collect()} == {"seen"}


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "words here", None), (3, None, "en")])
    assert {(r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs)).collect()} == {("und", 0.0)}
    assert language.predict(frame(spark, []), language.fit(frame(spark, []))).count() == 0


def test_language_features_do_not_depend_on_pieces():
    text = speech(np.random.default_rng(1), "abcdé", 500)
    whole = language.histogram(text, 1 << 20)
    for size in (1, 50, 1000):
        got = language.histogram(text, size)
        assert np.array_equal(got[0], whole[0]) and np.array_equal(got[1], whole[1])


# --- phrases ---------------------------------------------------------------


def phrases_by_hand(rows, least, top):
    f = defaultdict(Counter)
    for _, t, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", fx.lowered(t)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cands.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in cands.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, low, high = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), low, high))
        for rank, (s, a, p, low, high) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, low, high, n, -s))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(8)
    words = ["the", "The", "of", "é", "ünder", "a\x01", "x-y", "z z", "new", "york", "city", "\x00", "long" * 300]
    weight = np.array([9, 3, 6, 2, 2, 1, 1, 1, 3, 3, 3, 1, 0.3])
    say = lambda n: "".join(str(rng.choice(words, p=weight / weight.sum())) + str(rng.choice([" ", "\t", "  ", ", ", "\n"], p=[0.7, 0.1, 0.1, 0.05, 0.05])) for _ in range(n))
    rows = [(i, say(int(rng.integers(0, 120))), str(rng.choice(["en", "fr", "de"], p=[0.6, 0.3, 0.1]))) for i in range(150)]
    rows += [(200, "new york city " * 60, "en"), (201, None, "en"), (202, "", None), (203, say(300), None), (None, say(100), "und"), (204, say(4000), "fr"), (204, " ,;", "xx"), (3, rows[3][1], "en")]
    return rows


@pytest.mark.parametrize(("ranges", "held"), [(1, phrases.HELD), (7, 500), (60, 1)])
def test_phrases(spark, ranges, held, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", held)
    rows = phrase_rows()
    got = phrases.mine_phrases(frame(spark, rows), ranges, least=4, top=40).collect()
    want = phrases_by_hand(rows, 4, 40)
    assert len(want) > 100
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == want


def test_phrases_of_nothing(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, "one", "en")]):
        assert phrases.mine_phrases(frame(spark, rows)).count() == 0


def sequences(counts):
    return {x: int(w) for d in range(3) for x, w in zip(counts.text(d, np.arange(len(counts.levels[d]))), counts.levels[d].weight, strict=True) if w}


def test_automaton_round_trip_union_and_cut():
    rng = np.random.default_rng(2)
    parts, want = [], Counter()
    for _ in range(4):
        words, ids, piece = phrases.tokenise([b" ".join(rng.choice([b"a", b"b", b"c", b"dd", b"d"], 200)) + b"." for _ in range(3)])
        parts.append(transducer.Counts.count(words, ids, piece))
        want.update(sequences(parts[-1]))
    whole = transducer.Counts.union(parts)
    assert sequences(whole) == want
    raw = transducer.pack(whole)
    assert sequences(transducer.Automaton(raw).counts()) == want
    assert len(transducer.Automaton(transducer.pack(whole.at_least(1000))).weight) == 1
    borders = sorted({(b"a", b"", b""), (b"a", b"b", b"bb"), (b"b", b"c", b"dd"), (b"d", b"d", b"d"), (b"zz", b"", b"")})
    pieces = [sequences(p) for _, p in whole.cut(borders)]
    assert sum(map(len, pieces)) == len(want) and {k: v for p in pieces for k, v in p.items()} == want
    found, pair = transducer.Automaton(raw).compose(whole)
    assert all(np.array_equal(x, level.weight) for x, level in zip(found, whole.levels, strict=True))
    assert np.array_equal(pair, np.arange(len(pair)))


def test_automaton_is_minimal():
    # every word is followed by the same counts: one state for all of them
    words = [b"%03d" % i for i in range(200)]
    ids = np.concatenate([[i, 0] for i in range(1, 200)])
    counts = transducer.Counts.count(words, ids, np.repeat(np.arange(199), 2))
    assert len(transducer.Automaton(transducer.pack(counts)).weight) <= 5

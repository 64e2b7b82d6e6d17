"""Toxicity: exact neighbours, held-out accuracy, awkward rows."""

import mmap
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablework.llm import toxicity


def corpus(n: int = 500):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["vilest", "moronix", "scumbag", "wretchol"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "en", "s"]) + rng.choice(["", ".", ","]))
        docs.append((i, " ".join(words).capitalize(), "x", 1.0, 2, "e"))
        if i % 5 != 1:
            labels.append((i, 1, toxic))
    docs += [(n, None, "x", 1.0, 2, "e"), (n + 1, "", "x", 1.0, 2, "e"), (n + 2, "zzz " * 50_000, "x", 1.0, 2, "e"), (None, "scumbag vilest moronix", "x", 1.0, 2, "e"), (0, docs[0][1], "x", 1.0, 2, "e")]
    labels += [(3, 1, None), (None, 1, 1), (0, 1, labels[0][2]), (99_999, 1, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return (
        spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double, predicted int, f string").repartition(3).cache(),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(),
    )


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.fit(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    rows = toxicity.score(docs, model).join(labels.dropna().distinct(), "doc_id").select("doc_id", "score", "predicted", "toxic", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.h]
    assert len(held) > 50 and np.mean([r.predicted == r.toxic for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_are_not_learned(tables, model):
    ids = set(model.index.ids.tolist())
    assert ids and not [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]


def test_awkward_rows(tables, model):
    got = {r.doc_id: r for r in toxicity.score(tables[0], model).collect()}
    assert len(toxicity.score(tables[0], model).collect()) == tables[0].count()
    for i in (500, 501, 502):
        assert got[i].predicted == 0 and got[i].evidence == []
    assert got[None].predicted == 1 and got[None].evidence[0].similarity > 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    n_terms, n = 40, 700
    vectors = [{int(t): int(rng.integers(1, 5)) for t in rng.choice(n_terms, rng.integers(1, 6), replace=False)} for _ in range(n)]
    idf = rng.uniform(1, 6, n_terms)
    index = toxicity.Index.build(vectors, list(range(n)), [0] * n, idf)
    units = [toxicity.unit(v, idf) for v in vectors]
    dense = np.zeros((n, n_terms))
    for at, i in enumerate(index.ids):
        for t, w in units[i].items():
            dense[at, t] = w
    for q in vectors[:60]:
        query = toxicity.unit(q, idf)
        scores = dense @ np.array([query.get(t, 0.0) for t in range(n_terms)])
        want = [(round(float(scores[i]), 12), int(i)) for i in sorted(range(n), key=lambda i: (-round(float(scores[i]), 12), i))[:15] if scores[i] > 0]
        assert [(pytest.approx(s, abs=1e-9), i) for s, i in want] == index.nearest(query, 15)


def test_keep_clean_keeps_columns_and_clean_rows(tables, model):
    kept = toxicity.keep_clean(tables[0], model)
    assert kept.columns == tables[0].columns
    toxic = toxicity.score(tables[0], model).where("predicted = 1").count()
    assert kept.count() == tables[0].count() - toxic


def test_without_labels_or_rows(spark, tables):
    docs, labels = tables
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_whole_query_against_dense_cosine(tables, model):
    """Scores and evidence of every row from dense vectors over all words of
    the examples, with document frequencies counted here."""
    docs, labels = tables
    rows = docs.select("doc_id", "text").collect()
    known: dict[int, int] = {}
    for r in labels.dropna().collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)
    counts = []
    for r in rows:
        c: dict[str, int] = {}
        for w in toxicity.words((r.text or "").encode()):
            for f in toxicity.features(w):
                c[f] = c.get(f, 0) + 1
        counts.append(c)
    examples = {r.doc_id: c for r, c in zip(rows, counts) if r.doc_id in known}
    every_word = {f for c in examples.values() for f in c if not f.endswith("~")}
    assert every_word == {t for t in model.terms if not t.endswith("~")}
    at = {t: i for i, t in enumerate(model.terms)}
    df = np.zeros(len(at))
    for c in counts:
        df[[at[f] for f in c if f in at]] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    telling = np.isclose(model.index.idf, idf)
    assert (telling | np.isclose(model.index.idf, toxicity.UNTOLD * idf)).all()
    assert all(telling[at[f]] for f in at if f.endswith("~")) and {"vilest", "scum~"} <= {f for f in at if telling[at[f]]}
    weight = np.where(telling, 1.0, toxicity.UNTOLD) * idf
    unseen = toxicity.UNTOLD * (np.log(1 + len(rows)) + 1)

    def dense(c):
        v = np.zeros(len(at))
        for f, n in c.items():
            if f in at:
                v[at[f]] = (1 + np.log(n)) * weight[at[f]]
        other = sum(((1 + np.log(n)) * unseen) ** 2 for f, n in c.items() if f not in at and not f.endswith("~"))
        length = np.sqrt((v * v).sum() + other)
        return v / length if length else v

    ids = [int(i) for i in model.index.ids]
    matrix = np.array([dense(examples[i]) for i in ids])
    want = []
    for r, c in zip(rows, counts):
        similar = np.round(matrix @ dense(c), 9)
        near = [i for i in sorted(range(len(ids)), key=lambda i: (-similar[i], i))[: toxicity.NEIGHBOURS] if similar[i] > 0]
        total = sum(similar[i] for i in near)
        vote = (sum(similar[i] * known[ids[i]] for i in near) + toxicity.PRIOR_WEIGHT * model.prior) / (total + toxicity.PRIOR_WEIGHT) if near else model.none_rate
        want.append((r.doc_id, toxicity.calibrated(vote, model.curve), [similar[i] for i in near[: toxicity.N_EVIDENCE]]))
    got = [(r.doc_id, r.score, [e.similarity for e in r.evidence]) for r in toxicity.score(docs, model).collect()]

    def order(x):
        return x[0] is None, x[0] or 0, x[1]

    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-6) and g[2] == pytest.approx(w[2], abs=1e-6)


def test_one_example_for_an_id_and_a_bound_on_text(spark, tables):
    docs, labels = tables
    many = docs.unionByName(docs.where("doc_id = 2").withColumn("text", F.lit("another text")))
    few = toxicity._sample(toxicity.id_and_text(many), labels, 50, 1 << 30).collect()
    assert len(few) == len({r.doc_id for r in few}) <= 50
    small = toxicity._sample(toxicity.id_and_text(many), labels, 50, 3000).collect()
    assert 0 < sum(len((r.text or "").encode()) for r in small) <= 3000


@pytest.mark.parametrize("dense", [0, 8, 512])
def test_frequent_terms_are_rows_and_neighbours_stay_exact(monkeypatch, dense):
    """Postings are met for the rarer terms only; copies and an example left
    out, in vectors scored together."""
    monkeypatch.setattr(toxicity, "DENSE", dense)
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    rng = np.random.default_rng(4)
    n_terms, n = 900, 300
    vectors = [{t: 1 for t in range(8)} | {int(t): int(rng.integers(1, 4)) for t in rng.choice(np.arange(8, n_terms), 5, replace=False)} for _ in range(n)]
    vectors += vectors[:40]
    idf = rng.uniform(1, 6, n_terms)
    index = toxicity.Index.build(vectors, list(range(len(vectors))), [0] * len(vectors), idf)
    assert len(index.example) <= {0: 13, 8: 5, 512: 2}[dense] * len(vectors)
    matrix = np.zeros((len(vectors), n_terms))
    for at, i in enumerate(index.ids):
        for t, w in toxicity.unit(vectors[i], idf).items():
            matrix[at, t] = w
    skip = [at if at % 2 else -1 for at in range(len(vectors))]
    queries = [(np.flatnonzero(row), row[np.flatnonzero(row)]) for row in matrix]
    for row, without, got in zip(matrix, skip, index.nearest_to(queries, 15, skip)):
        similar = np.round(matrix @ row, 12)
        if without >= 0:
            similar[without] = 0
        want = sorted(similar[similar > 0], reverse=True)[:15]
        assert [s for s, _ in got] == pytest.approx(want, abs=1e-9) and without not in [i for _, i in got]
        assert got == sorted(got, key=lambda x: (-x[0], x[1])) and all(similar[i] == pytest.approx(s, abs=1e-9) for s, i in got)


def test_words_of_latin_texts_are_those_of_the_pattern():
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(256), rng.randrange(97, 123), 32, 0x130, 0x4E2D, 0x2019][: rng.choice([3, 6])])) for _ in range(60)) for _ in range(500)]
    for t in ["", "a_b2c²d ªº µÀÿ İx", *texts]:
        assert toxicity.words(t.encode()) == toxicity._WORD.findall(t.lower())


class Kept(toxicity.Model):
    """A model that stays on the driver."""

    def __reduce__(self):
        raise TypeError("the model was put into a task's function")


def test_tasks_map_the_model(spark, tables, model):
    shipped = toxicity.ship(spark, model)
    opened = shipped.open()
    assert opened.terms == model.terms and len(pickle.dumps(shipped)) < 4096
    for name in toxicity.ARRAYS:
        a = b = getattr(opened.index, name)
        while isinstance(b, np.ndarray):
            b = b.base
        assert isinstance(b, mmap.mmap) and np.array_equal(a, getattr(model.index, name))
    texts = [(r.text or "").encode() for r in tables[0].limit(80).collect()]
    assert list(opened.scores(texts)) == list(model.scores(texts))


def test_the_model_is_in_no_task(tables, model):
    docs, kept = tables[0], Kept(model.terms, model.index, model.prior, model.none_rate, model.unseen, model.curve)
    clean = sum(s < 0.5 for s, _ in model.scores([(r.text or "").encode() for r in docs.collect()]))
    assert toxicity.keep_clean(docs, kept).count() == clean
    assert toxicity.score(docs, kept).where("predicted = 0").count() == clean
    assert toxicity.keep_clean(docs, Kept([])).count() == docs.count()

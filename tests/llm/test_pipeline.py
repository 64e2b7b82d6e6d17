"""The pipeline stage by stage, and the registry."""

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
import fixture as fx
from tablework.llm import content_sort, packing, parity_join, secret_scan, toxicity
SF_SMALL = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_duplicates", "secret_scan", "packing"]


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_columns_and_cope_with_awkward_rows(spark, at):
    docs = fx.frame(spark)
    out = corpus_pipeline.STAGES[at][1](spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    assert 0 < out.count() <= docs.count()
    none = fx.frame(spark, [])
    assert corpus_pipeline.STAGES[at][1](spark, none, SF_SMALL).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    clean = [(r.doc_id, r.text) for r in docs.collect() if model.score((r.text or "").encode())[0] < 0.5]
    last = {}
    for i, t in clean:
        last[fx.lowered(t)] = max(i, last.get(fx.lowered(t), i))
    unique = sorted((i, t) for i, t in clean if last[fx.lowered(t)] == i)
    first = [x for k, (x, c) in enumerate(zip(unique, fx.components(unique), strict=True)) if c == k or not fx.shingle_set(x[1])]
    masked = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(first, "doc_id long, text string")).collect()}
    want = packing.pieces(spark.createDataFrame(list(masked.items()), "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).drop("ids").collect()
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    cols = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(tuple(r[c] for c in cols) for r in want)


def test_registry_has_the_ten_and_the_pipeline():
    names = __spark_entry__.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10
    assert "pipeline" in names
    assert {"op2_exact_dedup", "op3_warc_round_trip"} <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_warc_round_trip"])
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF_SMALL)
    want = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_near_copies_and_exact_copies_go(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    once = content_sort.keep_one(docs)
    assert once.count() == once.select("doc_id").distinct().count()
    assert parity_join.keep_first(once).count() <= once.count()

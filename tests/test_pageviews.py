"""Pageview ingest: item unnest, keyed upsert, incremental stream (FX4, N1)."""

import datetime as dt
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tablework.contracts import PAGEVIEWS_DAILY, PAGEVIEWS_KEY
from tablework.operators.quality import ContractError
from tablework.plans import pageviews as pv
from tablework.sinks.keyed import KeyedTable
from tablework.sinks.store import TableStore
from tablework.sources.json_scan import unnest_items
from tablework.streaming.incremental import ITEM_PAYLOAD_SCHEMA, stream_upsert


def item(ts, views, granularity="daily", project="en.wikipedia"):
    return {"project": project, "article": "ignored", "granularity": granularity, "timestamp": ts,
            "access": "all-access", "agent": "user", "views": views}


def payload_df(spark, payloads):
    return spark.createDataFrame([(p["article"], p["items"]) for p in payloads], ITEM_PAYLOAD_SCHEMA)


def new_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.ensure_table("pageviews_daily", PAGEVIEWS_DAILY, not_null=PAGEVIEWS_DAILY.fieldNames(), primary_key=PAGEVIEWS_KEY,
                       partition_expr="date_format(viewed_on, 'yyyy-MM')")
    return store


def test_unnest_items_takes_article_from_request(spark):
    df = payload_df(spark, [{"article": "Spark", "items": [item("2024010100", 5), item("2024010200", 7)]}])
    rows = unnest_items(df, ["article"], "2024-01-03 06:17:00").orderBy("viewed_on").collect()
    assert [(r["article"], r["viewed_on"], r["views"]) for r in rows] == [("Spark", dt.date(2024, 1, 1), 5), ("Spark", dt.date(2024, 1, 2), 7)]
    assert rows[0]["loaded_at_utc"] == dt.datetime(2024, 1, 3, 6, 17)


def test_upsert_reload_corrects_and_is_idempotent(spark, tmp_path):
    store = new_store(spark, tmp_path)
    first = unnest_items(payload_df(spark, [{"article": "A", "items": [item("2024013100", 5), item("2024020100", 6)]}]), ["article"], "2024-02-02 06:17:00")
    store.upsert("pageviews_daily", first, PAGEVIEWS_KEY)
    again = unnest_items(payload_df(spark, [{"article": "A", "items": [item("2024020100", 9), item("2024020200", 1)]}]), ["article"], "2024-02-03 06:17:00")
    store.upsert("pageviews_daily", again, PAGEVIEWS_KEY)
    store.upsert("pageviews_daily", again, PAGEVIEWS_KEY)
    rows = {(r["viewed_on"].isoformat(), r["views"]) for r in store.read("pageviews_daily").collect()}
    assert rows == {("2024-01-31", 5), ("2024-02-01", 9), ("2024-02-02", 1)}
    # only the February partition was rewritten; January is carried over.
    parts = {p for p, _ in store.tables()["pageviews_daily"].paths}
    assert parts == {"2024-01", "2024-02"}


def test_upsert_rejects_repeated_key_and_keeps_table(spark, tmp_path):
    store = new_store(spark, tmp_path)
    ok = unnest_items(payload_df(spark, [{"article": "A", "items": [item("2024013100", 5)]}]), ["article"], "2024-02-02 06:17:00")
    store.upsert("pageviews_daily", ok, PAGEVIEWS_KEY)
    dup = unnest_items(payload_df(spark, [{"article": "A", "items": [item("2024013100", 1), item("2024013100", 2)]}]), ["article"], "2024-02-02 06:17:00")
    with pytest.raises(ContractError):
        store.upsert("pageviews_daily", dup, PAGEVIEWS_KEY)
    assert [r["views"] for r in store.read("pageviews_daily").collect()] == [5]


def test_granularity_is_not_part_of_the_key(spark, tmp_path):
    store = new_store(spark, tmp_path)
    daily = unnest_items(payload_df(spark, [{"article": "A", "items": [item("2024013100", 5)]}]), ["article"], "2024-02-02 06:17:00")
    store.upsert("pageviews_daily", daily, PAGEVIEWS_KEY)
    monthly = unnest_items(payload_df(spark, [{"article": "A", "items": [item("2024013100", 8, granularity="monthly")]}]), ["article"], "2024-02-02 06:17:00")
    store.upsert("pageviews_daily", monthly, PAGEVIEWS_KEY)
    rows = store.read("pageviews_daily").collect()
    assert [(r["granularity"], r["views"]) for r in rows] == [("monthly", 8)]


def test_stream_upsert_two_drops(spark, tmp_path):
    store = new_store(spark, tmp_path)
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "drop1.json").write_text(json.dumps({"article": "A", "items": [item("2024013100", 5), item("2024020100", 6)]}) + "\n")
    n1 = stream_upsert(spark, str(landing), store, "pageviews_daily", PAGEVIEWS_KEY, checkpoint=str(tmp_path / "ckpt"))
    assert n1 == 1
    (landing / "drop2.json").write_text(json.dumps({"article": "A", "items": [item("2024020100", 60)]}) + "\n")
    n2 = stream_upsert(spark, str(landing), store, "pageviews_daily", PAGEVIEWS_KEY, checkpoint=str(tmp_path / "ckpt"))
    assert n2 == 1
    rows = {(r["viewed_on"].isoformat(), r["views"]) for r in store.read("pageviews_daily").collect()}
    assert rows == {("2024-01-31", 5), ("2024-02-01", 60)}
    # nothing new landed: no batch, table unchanged
    assert stream_upsert(spark, str(landing), store, "pageviews_daily", PAGEVIEWS_KEY, checkpoint=str(tmp_path / "ckpt")) == 0


def test_stream_upsert_on_a_new_checkpoint_loses_nothing(spark, tmp_path):
    """A restart whose stream checkpoint is gone reads all files again: batch
    numbers start at 0 once more, and newly landed days still arrive."""
    store = new_store(spark, tmp_path)
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "drop1.json").write_text(json.dumps({"article": "A", "items": [item("2024013100", 5)]}) + "\n")
    stream_upsert(spark, str(landing), store, "pageviews_daily", PAGEVIEWS_KEY, checkpoint=str(tmp_path / "ckpt1"))
    (landing / "drop2.json").write_text(json.dumps({"article": "A", "items": [item("2024020100", 6)]}) + "\n")
    assert stream_upsert(spark, str(landing), store, "pageviews_daily", PAGEVIEWS_KEY, checkpoint=str(tmp_path / "ckpt2")) == 1
    assert {(r["viewed_on"].isoformat(), r["views"]) for r in store.read("pageviews_daily").collect()} == {("2024-01-31", 5), ("2024-02-01", 6)}


def test_summary_trend_and_kpis(spark):
    rows = [
        ("p", "A", "all-access", "user", "daily", dt.date(2024, 1, 20), 10, dt.datetime(2024, 1, 31, 6)),
        ("p", "A", "all-access", "user", "daily", dt.date(2024, 1, 28), 4, dt.datetime(2024, 1, 31, 6)),
        ("p", "B", "all-access", "user", "daily", dt.date(2024, 1, 28), 14, dt.datetime(2024, 1, 30, 6)),
    ]
    daily = spark.createDataFrame(rows, PAGEVIEWS_DAILY)
    summary = pv.article_summary(daily, "2024-01-31")
    got = {r["article"]: (r["total_views"], r["views_last_7_days"], r["avg_daily_views"]) for r in summary.collect()}
    assert got == {"A": (14, 4, 7.0), "B": (14, 14, 14.0)}
    kpi = pv.pageview_kpis(summary).first()
    assert (kpi["total_views"], kpi["views_last_7_days"], kpi["articles"], kpi["leading_article"]) == (28, 18, 2, "A")
    assert kpi["leading_loaded_at_utc"] == dt.datetime(2024, 1, 31, 6)
    wide = pv.daily_trend_wide(daily, "2024-01-31", ["A", "B"], how="last").collect()
    assert [(r["viewed_on"], r["A"], r["B"]) for r in wide] == [("2024-01-20", 10, None), ("2024-01-28", 4, 14)]
    long_rows = pv.daily_trend(daily, "2024-01-31", days=5).collect()
    assert [(r["viewed_on"], r["article"]) for r in long_rows] == [("2024-01-28", "A"), ("2024-01-28", "B")]
    assert F is not None


def test_upsert_with_null_partition_value(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.ensure_table("t", spark.createDataFrame([], "k int, d date, v int").schema,
                       primary_key=["k"], partition_expr="date_format(d, 'yyyy-MM')")
    store.upsert("t", spark.createDataFrame([(1, None, 1), (2, dt.date(2024, 1, 1), 2)], "k int, d date, v int"), ["k"])
    store.upsert("t", spark.createDataFrame([(1, None, 10)], "k int, d date, v int"), ["k"])
    assert sorted(tuple(r) for r in store.read("t").select("k", "v").collect()) == [(1, 10), (2, 2)]


def test_replayed_batch_leaves_the_table_as_it_is(spark, tmp_path):
    from tablework.streaming.incremental import upsert_batch

    store = new_store(spark, tmp_path)
    batch = payload_df(spark, [{"article": "A", "items": [item("2024013100", 5)]}]).select(
        "*", F.lit(1).cast("timestamp").alias("__mtime"), F.lit("f1").alias("__file")
    )
    assert upsert_batch(store, "pageviews_daily", batch, PAGEVIEWS_KEY, loaded_at="2024-02-01 06:00:00")
    before = store.read("pageviews_daily").collect()
    assert upsert_batch(store, "pageviews_daily", batch, PAGEVIEWS_KEY, loaded_at="2024-02-01 06:00:00")  # replay after a crash
    assert store.read("pageviews_daily").collect() == before
    later = payload_df(spark, [{"article": "A", "items": [item("2024013100", 7)]}]).select(
        "*", F.lit(2).cast("timestamp").alias("__mtime"), F.lit("f2").alias("__file")
    )
    older = batch
    assert upsert_batch(store, "pageviews_daily", later.unionByName(older), PAGEVIEWS_KEY)
    assert [r["views"] for r in store.read("pageviews_daily").collect()] == [7]  # newest landed file wins


# --- the same on a bucketed table of Spark's catalog -----------------------


def keyed_table(spark, tmp_path):
    name = f"pv_{uuid.uuid4().hex}"
    return KeyedTable(spark, name, str(tmp_path / "pv"), PAGEVIEWS_DAILY, PAGEVIEWS_KEY, F.date_format("viewed_on", "yyyy-MM"), "month", buckets=3)


def daily_rows(spark, *items):
    return unnest_items(payload_df(spark, [{"article": "A", "items": list(items)}]), ["article"], "2024-02-02 06:17:00")


def views(table):
    return sorted((r["viewed_on"].isoformat(), r["views"]) for r in table.read().collect())


def test_keyed_table_rewrites_only_the_months_it_touches(spark, tmp_path):
    table = keyed_table(spark, tmp_path)
    assert table.upsert(daily_rows(spark, item("2024013000", 4), item("2024013100", 5), item("2024020100", 6))) == ["2024-01", "2024-02"]
    january = sorted(os.listdir(tmp_path / "pv" / "month=2024-01"))
    assert table.upsert(daily_rows(spark, item("2024020100", 60), item("2024020200", 7))) == ["2024-02"]
    assert sorted(os.listdir(tmp_path / "pv" / "month=2024-01")) == january
    assert views(table) == [("2024-01-30", 4), ("2024-01-31", 5), ("2024-02-01", 60), ("2024-02-02", 7)]
    with pytest.raises(ContractError):
        table.upsert(daily_rows(spark, item("2024020100", 1), item("2024020100", 2)))
    assert table.upsert(daily_rows(spark)) == []
    assert len(views(table)) == 4


def test_keyed_table_outlives_its_session(spark, tmp_path):
    keyed_table(spark, tmp_path).upsert(daily_rows(spark, item("2024013100", 5)))
    again = keyed_table(spark, tmp_path)  # another name: as in a new session, nothing is known of the first
    assert views(again) == [("2024-01-31", 5)]
    again.upsert(daily_rows(spark, item("2024013100", 8)))
    assert views(again) == [("2024-01-31", 8)]


def test_keyed_table_does_not_shuffle_what_is_stored(spark, tmp_path):
    table = keyed_table(spark, tmp_path)
    table.upsert(daily_rows(spark, item("2024013100", 5), item("2024013000", 4)))
    incoming = spark.createDataFrame(daily_rows(spark, item("2024013100", 8)).collect(), PAGEVIEWS_DAILY).withColumn("month", F.lit("2024-01"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.upsert_plan(incoming, ["2024-01"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "FullOuter" in plan
    assert "Bucketed: true" in plan and "PartitionFilters: [isnotnull(month" in plan
    stored = plan[: plan.index("FileScan")].splitlines()
    assert "Exchange" not in "".join(stored[-3:])  # between the scan and the join


def test_stream_into_a_keyed_table_replays_and_restarts(spark, tmp_path):
    table = keyed_table(spark, tmp_path)
    landing = tmp_path / "landing"
    landing.mkdir()
    run = lambda checkpoint: stream_upsert(spark, str(landing), table, table.name, PAGEVIEWS_KEY, checkpoint=str(tmp_path / checkpoint))
    (landing / "drop1.json").write_text(json.dumps({"article": "A", "items": [item("2024013100", 5), item("2024020100", 6)]}) + "\n")
    assert run("one") == 1
    (landing / "drop2.json").write_text(json.dumps({"article": "A", "items": [item("2024020100", 60)]}) + "\n")
    assert run("one") == 1 and run("one") == 0
    assert views(table) == [("2024-01-31", 5), ("2024-02-01", 60)]
    (landing / "drop3.json").write_text(json.dumps({"article": "A", "items": [item("2024030100", 1)]}) + "\n")
    assert run("two") == 1  # a new checkpoint reads all files again
    assert views(table) == [("2024-01-31", 5), ("2024-02-01", 60), ("2024-03-01", 1)]


def test_upsert_join_keeps_rows_without_a_key(spark):
    from tablework.sinks.keyed import upsert_join

    target = spark.createDataFrame([(1, "a"), (2, None), (None, "x")], "k int, v string")
    incoming = spark.createDataFrame([(2, None), (1, None), (3, "c"), (None, "y")], "k int, v string")
    got = upsert_join(target, incoming, ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None), (2, None), (3, "c"), (None, "x"), (None, "y")], key=str)

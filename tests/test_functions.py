"""Scalar functions, starter metrics, exact median and small sources."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablework.functions import columns as fx
from tablework.operators.aggregates import exact_median
from tablework.plans import starter as st
from tablework.sinks.store import KEEP, TableStore
from tablework.sources import generated as gen
from tablework.sources.json_scan import drop_matching_lines


@pytest.mark.parametrize(
    "name, slug",
    [("Feature/ABC-123", "feature_abc_123"), ("__x__", "x"), ("", "preview"), ("!!!", "preview"),
     ("a" * 60, "a" * 48), ("a" * 47 + "-b", "a" * 47 + "_")],
)
def test_branch_slug(spark, name, slug):
    assert spark.createDataFrame([(name,)], "n string").select(fx.branch_slug("n")).first()[0] == slug


def test_split_list_and_labels(spark):
    row = spark.createDataFrame([(" a, ,b ,,c ",)], "s string").select(fx.split_list("s").alias("l"), fx.metric_label(F.lit("daily_queries")).alias("m")).first()
    assert row["l"] == ["a", "b", "c"] and row["m"] == "daily queries"


def test_drop_matching_lines(spark):
    cases = ["a\nLICENSE x\nb", "a\nMIT License", "License\n", "none", "x license\ny license\n"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(drop_matching_lines(F.col("t"), "[Ll]icense|LICENSE")).collect()]
    assert got == ["a\nb", "a\n", "", "none", ""]


def test_starter_daily_metrics(spark):
    daily = st.starter_daily_metrics(spark, "2024-03-14", dt.datetime(2024, 3, 14, 6))
    assert daily.count() == 42
    summary = {r["metric"]: r for r in st.starter_metric_summary(daily).collect()}
    assert {m: r["current_value"] for m, r in summary.items()} == {"active_accounts": 144, "daily_queries": 6315, "shared_databases": 17}
    assert summary["active_accounts"]["first_measured_on"] == dt.date(2024, 3, 1)
    assert summary["daily_queries"]["avg_value"] == pytest.approx(5112.5)


def test_value_at_latest_skips_nulls(spark):
    df = spark.createDataFrame([("m", dt.date(2024, 1, 1), 5), ("m", dt.date(2024, 1, 2), None)], "metric string, measured_on date, value long").withColumn(
        "loaded_at_utc", F.current_timestamp()
    )
    assert st.starter_metric_summary(df).first()["current_value"] == 5


def test_exact_median_matches_python(spark):
    rnd = random.Random(7)
    vals = [float(rnd.randint(0, 50)) for _ in range(2001)] + [None] * 5 + [7.0] * 700
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    clean = sorted(v for v in vals if v is not None)
    n = len(clean)
    want = (clean[(n - 1) // 2] + clean[n // 2]) / 2
    assert exact_median(df, "x") == want
    # force the narrowing path with a tiny collect limit
    assert exact_median(df, "x") == want
    assert exact_median(df.where("x is null"), "x") is None


def test_day_series_and_staging(spark):
    days = [r["measured_on"] for r in gen.day_series(spark, "2024-01-14", 3).orderBy("day_index").collect()]
    assert days == [dt.date(2024, 1, 12), dt.date(2024, 1, 13), dt.date(2024, 1, 14)]
    with pytest.raises(ValueError):
        gen.stage_rows(spark, [], "a int", "empty_view")
    gen.stage_rows(spark, [(1,)], "a int", "one_view")
    assert spark.table("one_view").count() == 1


def test_snapshot_include_filter(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "db"))
    share = TableStore(spark, str(tmp_path / "share"))
    store.replace_table("fields", spark.createDataFrame([(1,)], "a int"))
    store.replace_table("audit.runs", spark.createDataFrame([(1,)], "a int"))
    assert store.publish_snapshot(share, None) == ["audit.runs", "fields"]
    assert store.publish_snapshot(share, ["main.*"]) == ["fields"]
    assert store.publish_snapshot(share, KEEP) == ["fields"]
    assert store.publish_snapshot(share, []) == []


def test_replace_table_twice_same_content(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "db"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    store.replace_table("t", df)
    first = sorted(tuple(r) for r in store.read("t").collect())
    store.replace_table("t", store.read("t"))
    assert sorted(tuple(r) for r in store.read("t").collect()) == first
    assert store.version() == 2


def test_load_time_is_utc_seconds():
    import re

    assert re.fullmatch(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", fx.load_time())


def test_typed_literals_and_split_first(spark):
    row = spark.range(1).select(
        fx.string_array([]).alias("empty_list"),
        fx.string_map([], []).alias("empty_map"),
        fx.string_map(["k"], ["v"]).alias("one"),
    ).first()
    assert row["empty_list"] == [] and row["empty_map"] == {} and row["one"] == {"k": "v"}
    df = spark.createDataFrame([("12|RUN|x",), ("nosep",)], "s string")
    head, rest = fx.split_first(F.col("s"))
    got = [(r[0], r[1]) for r in df.select(head, rest).collect()]
    assert got == [("12", "RUN|x"), ("nosep", None)]
    types = spark.range(1).select(fx.string_array([]).alias("a"), fx.string_map([], []).alias("m")).schema
    assert types["a"].dataType.simpleString() == "array<string>" and types["m"].dataType.simpleString() == "map<string,string>"


def test_store_two_writers_cannot_commit_same_version(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "db"))
    store.replace_table("t", spark.createDataFrame([(1,)], "a int"))
    version, tables, meta = store._read_manifest()
    store._commit(version, tables, meta)  # first writer wins version + 1
    with pytest.raises(Exception):
        store._commit(version, tables, meta)  # second writer saw the same version
    assert store.version() == version + 1
    assert store.read("t").count() == 1

"""Hot keys: one key holds a third of all rows."""

import re

from pyspark.sql import functions as F

from tablework.operators import quality as q
from tablework.operators import ranges as rg
from tablework.operators import shape
from tablework.operators.aggregates import exact_median
from tablework.operators.ranges import Ranges
from tablework.operators.windows import latest_per_key
from tablework.plans import changes as ch

N = 30000


def hot(spark):
    # key 0 holds a third of the rows, the rest are spread over 1000 keys
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
        F.col("id").alias("v"),
    )


def test_latest_per_key_limits_before_shuffle(spark):
    df = hot(spark)
    out = latest_per_key(df, ["k"], [F.col("v").desc()])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    got = {r["k"]: r["v"] for r in out.collect()}
    assert got[0] == max(i for i in range(N) if i % 3 == 0)
    assert len(got) == 1001


def test_median_with_hot_value(spark):
    df = hot(spark).select(F.col("k").cast("double").alias("x"))
    vals = sorted(0.0 if i % 3 == 0 else float(i % 1000 + 1) for i in range(N))
    want = (vals[(N - 1) // 2] + vals[N // 2]) / 2
    assert exact_median(df, "x") == want


def test_separation_does_not_pair_duplicates(spark):
    df = hot(spark).select("k", F.lit("same").alias("name"))
    out = q.check_separation(df, df, ["k"], ["name"])
    assert out.count() == 1001  # one row per key, not |group|^2 pairs


def test_lookup_of_a_hot_name_gives_one_row(spark):
    live = hot(spark).select(F.col("k").cast("string").alias("name"), F.col("v").cast("string").alias("id"))
    wanted = spark.createDataFrame([("0",), ("missing",)], "name string")
    out = {r["name"]: r for r in ch.lookup_one(wanted, live, ["name"]).collect()}
    assert (out["0"]["n_live"], out["0"]["live_id"]) == (N // 3, "0")
    assert out["missing"]["n_live"] == 0


def test_all_ids_of_a_hot_name_in_bounded_rows(spark):
    live = hot(spark).select(F.col("k").cast("string").alias("name"), F.col("v").cast("string").alias("id"))
    wanted = spark.createDataFrame([("0",), ("0",), ("7",), ("missing",)], "name string")
    rows = sorted(ch.ambiguous_ids(wanted, live, ["name"], chunk=100).collect(), key=lambda r: (r["name"], r["seq"]))
    for name in ("0", "7"):
        mine = [r for r in rows if r["name"] == name]
        want = sorted(str(i) for i in range(N) if (0 if i % 3 == 0 else i % 1000 + 1) == int(name))
        assert ",".join(r["ids"] for r in mine).split(",") == want
        assert [r["seq"] for r in mine] == list(range(len(mine)))
        assert [r["n_live"] for r in mine] == [len(want)] + [None] * (len(mine) - 1)
        assert max(len(r["ids"].split(",")) for r in mine) <= 100
    assert {r["name"] for r in rows} == {"0", "7"}


def test_a_hot_name_is_spread_over_ranges(spark):
    live = hot(spark).select("k", "v")
    # rows this small would be put into one range again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = Ranges(live, [F.col("k").asc(), F.col("v").asc()])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = ranges.rows.where("k = 0").groupBy("__range").count().collect()
    assert len(parts) > 1
    want = sorted((0 if i % 3 == 0 else i % 1000 + 1, i) for i in range(N))
    assert [(r["k"], r["v"]) for r in ranges.numbered().orderBy("rank").collect()] == want
    assert [(r["k"], r["v"]) for r in ranges.page(100, 9950).collect()] == want[9950:10050]


def test_ranges_stay_small_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(rg, "RANGE_ROWS", 1000)
    ranges = Ranges(hot(spark), [F.col("k").asc(), F.col("v").asc()])
    sizes = [r["count"] for r in ranges.rows.groupBy("__range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 2500  # borders come from a sample
    numbered = ranges.numbered()
    assert "Window [row_number" not in numbered._jdf.queryExecution().executedPlan().toString()
    want = sorted((0 if i % 3 == 0 else i % 1000 + 1, i) for i in range(N))
    assert [(r["k"], r["v"]) for r in numbered.orderBy("rank").collect()] == want
    live = hot(spark).select(F.col("k").cast("string").alias("name"), F.col("v").cast("string").alias("id"))
    rows = ch.ambiguous_ids(spark.createDataFrame([("0",)], "name string"), live, ["name"], chunk=100).orderBy("seq").collect()
    assert ",".join(r["ids"] for r in rows).split(",") == sorted(str(i) for i in range(0, N, 3))


def test_deep_page_reads_only_its_ranges(spark):
    df = hot(spark)
    order = [F.col("k").desc(), F.col("v").asc()]
    want = sorted(((0 if i % 3 == 0 else i % 1000 + 1, i) for i in range(N)), key=lambda x: (-x[0], x[1]))
    for offset, limit in ((N // 2, 50), (N - 5, 50), (1, N), (N + 1, 3)):
        assert [tuple(r) for r in shape.page(df, order, limit, offset).collect()] == want[offset : offset + limit]
    plan = Ranges(df, order).page(50, N // 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__range", plan)

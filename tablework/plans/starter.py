"""Starter-package marts (M8, M9) and the dense daily metric series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.operators.aggregates import value_at_latest
from tablework.sources.generated import values_table, with_day_series

# The starter seed (metric, base value, daily step) and length.
STARTER_SEED = [
    ("active_accounts", 118, 2),
    ("daily_queries", 3910, 185),
    ("shared_databases", 4, 1),
]
STARTER_DAYS = 14


def starter_daily_metrics(spark: SparkSession, as_of: str, loaded_at: dt.datetime, seed=STARTER_SEED, days: int = STARTER_DAYS) -> DataFrame:
    """M8: ``days`` dates ending at ``as_of`` for every seed metric, value =
    base + day_index * step (S5 x S6 as a generator, no cross join)."""
    seed_df = values_table(spark, seed, "metric string, base_value long, daily_step long")
    grid = with_day_series(seed_df, as_of, days)
    return grid.select(
        "metric",
        "measured_on",
        (F.col("base_value") + F.col("day_index") * F.col("daily_step")).cast("bigint").alias("value"),
        F.lit(loaded_at).cast("timestamp").alias("loaded_at_utc"),
    )


def dense_daily_counts(
    events: DataFrame,
    metric_col: str,
    ts_col: str,
    as_of: str,
    days: int,
    loaded_at: str,
) -> DataFrame:
    """Daily event counts per metric over ``days`` days ending at ``as_of``,
    with an explicit 0 for days without events.

    The metric list and the counts both come from one scan: counts are a
    partial aggregate, the grid is a generator on the (small) distinct
    metric rows, and the two meet in an equi join on (metric, day).
    """
    end = F.to_date(F.lit(as_of))
    in_range = events.where((F.to_date(ts_col) <= end) & (F.to_date(ts_col) >= F.date_sub(end, days - 1)))
    counts = in_range.groupBy(F.col(metric_col).alias("metric"), F.to_date(ts_col).alias("measured_on")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )
    metrics = events.select(F.col(metric_col).alias("metric")).where(F.col("metric").isNotNull()).distinct()
    grid = with_day_series(metrics, as_of, days)
    return grid.join(counts, ["metric", "measured_on"], "left").select(
        "metric",
        "measured_on",
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("value"),
        F.to_timestamp(F.lit(loaded_at)).alias("loaded_at_utc"),
    )


def starter_metric_summary(daily: DataFrame) -> DataFrame:
    """M9: per metric the value at the latest date (NULL values skipped),
    min, max, mean rounded to 2 digits, total, first/last date and load
    time."""
    return daily.groupBy("metric").agg(
        value_at_latest("value", "measured_on").cast("bigint").alias("current_value"),
        F.min("value").cast("bigint").alias("min_value"),
        F.max("value").cast("bigint").alias("max_value"),
        F.round(F.avg("value"), 2).cast("double").alias("avg_value"),
        F.sum("value").cast("bigint").alias("total_value"),
        F.min("measured_on").alias("first_measured_on"),
        F.max("measured_on").alias("last_measured_on"),
        F.max("loaded_at_utc").alias("loaded_at_utc"),
    )


def summary_listing(summary: DataFrame) -> DataFrame:
    """The starter dashboard's summary listing: dates and load time as text,
    largest current value first."""
    return summary.select(
        "metric",
        "current_value",
        "avg_value",
        "total_value",
        F.col("first_measured_on").cast("string").alias("first_measured_on"),
        F.col("last_measured_on").cast("string").alias("last_measured_on"),
        F.col("loaded_at_utc").cast("string").alias("loaded_at_utc"),
    ).orderBy(F.col("current_value").desc_nulls_last(), F.col("metric").asc())


def daily_listing(daily: DataFrame) -> DataFrame:
    """The starter dashboard's daily listing, by date then metric."""
    return daily.select(F.col("measured_on").cast("string").alias("measured_on"), "metric", "value").orderBy(
        F.col("measured_on").asc_nulls_last(), F.col("metric").asc_nulls_last()
    )

"""Aggregations (A1-A7) and the exact distributed median used by A3.

All grouped aggregates here are declarative ``groupBy().agg()`` so Spark
runs a partial (map-side) aggregate before the shuffle: a key holding a
third of all rows is reduced to one row per map task before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.functions.columns import fmt_utc, trailing_days
from tablework.session import checkpoint_dir


# ---------------------------------------------------------------- A1
def summarise(
    df: DataFrame,
    keys: Sequence[str],
    date_col: str,
    value_col: str,
    loaded_col: str,
    as_of: str,
    recent_days: int = 7,
    prefix: str = "viewed_on",
) -> DataFrame:
    """Per key: first/last date, total, mean, total of the last
    ``recent_days`` days (``date >= as_of - n``, inclusive) and latest
    load time."""
    recent = F.when(trailing_days(date_col, as_of, recent_days), F.col(value_col)).otherwise(F.lit(0))
    first_name = "first_" + prefix if prefix else "first_" + date_col
    last_name = "last_" + prefix if prefix else "last_" + date_col
    return df.groupBy(*keys).agg(
        F.min(date_col).alias(first_name),
        F.max(date_col).alias(last_name),
        F.sum(value_col).cast("bigint").alias("total_views"),
        F.avg(value_col).cast("double").alias("avg_daily_views"),
        F.sum(recent).cast("bigint").alias("views_last_7_days" if recent_days == 7 else f"views_last_{recent_days}_days"),
        F.max(loaded_col).alias("loaded_at_utc"),
    )


# ---------------------------------------------------------------- A2
def value_at_latest(value: str, by: str, tie: str | None = None) -> Column:
    """``arg_max(value, by)`` that skips NULL values (DuckDB semantics) and
    breaks ties on ``tie`` so the pick is deterministic."""
    order = F.struct(F.col(by), F.col(tie)) if tie else F.col(by)
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))


# ---------------------------------------------------------------- A3
def exact_median(df: DataFrame, column: str) -> float | None:
    """Exact median (linear interpolation at 0.5, as ``median`` in SQL).

    ``F.median`` on one global group collects every distinct value into a
    single task.  Here equal values collapse into one counted row (partial
    aggregate), the rows are range-partitioned and sorted, and running counts
    inside each range plus the counts of the ranges before give ranks; only
    the one or two middle values leave the executors, at any size.
    """
    checkpoint_dir(df.sparkSession)
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).repartitionByRange("v").withColumn("part", F.spark_partition_id())
    counted = counted.checkpoint(eager=True)
    before = counted.groupBy("part").agg(F.sum("c").alias("n"))  # one row per range
    along = Window.orderBy("part")
    before = before.select("part", (F.sum("n").over(along) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("c").over(inside)).join(before, "part").withColumn("upto", F.col("upto") + F.col("before"))
    lower, upper = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)  # from 0
    first = F.col("upto") - F.col("c")
    middle = ranked.where((first <= upper) & (F.col("upto") > lower)).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    return None if middle.lo is None else middle.lo * 0.5 + middle.hi * 0.5


def kpi_row(
    df: DataFrame,
    ratio_col: str,
    sum_cols: Sequence[tuple[str, str]],
    version_col: str,
    time_col: str,
    median_name: str = "median_recovery_pct",
    count_name: str = "field_count",
) -> DataFrame:
    """One KPI row, also on empty input: filtered count, exact median,
    sums, max version and formatted max load time.

    The input feeds several jobs (median narrowing, then the aggregate), so
    it is persisted (memory and disk; a lost block is recomputed from its
    lineage) for their duration.  The result is one row, materialised and
    returned as a one-row DataFrame so the cache can be released.
    """
    needed = list(dict.fromkeys([ratio_col, *(src for src, _ in sum_cols), version_col, time_col]))
    cached = df.select(*needed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        med = exact_median(cached, ratio_col)
        kpis = cached.agg(
            F.count_if(F.col(ratio_col).isNotNull()).cast("bigint").alias(count_name),
            F.lit(med).cast("double").alias(median_name),
            *[F.sum(src).alias(dst) for src, dst in sum_cols],
            F.max(version_col).alias(version_col),
            fmt_utc(F.max(time_col)).alias("loaded_at"),
        )
        row = kpis.first()
        return df.sparkSession.createDataFrame([tuple(row)], kpis.schema)
    finally:
        cached.unpersist()


# ---------------------------------------------------------------- A4
def load_stats(fields: DataFrame, history: DataFrame, version_col: str = "reserve_version") -> DataFrame:
    """Row counts of both tables and the max version (one row).

    Each table gets one global aggregate (partial per task, one row at the
    end); the two rows are combined by a union and a max, so no join and
    no driver round trip is involved.
    """
    null_long = F.lit(None).cast("bigint")
    f = fields.agg(
        F.count(F.lit(1)).alias("field_rows"),
        null_long.alias("reserve_history_rows"),
        F.lit(None).cast(history.schema[version_col].dataType).alias("latest_reserve_version"),
    )
    h = history.agg(
        null_long.alias("field_rows"),
        F.count(F.lit(1)).alias("reserve_history_rows"),
        F.max(version_col).alias("latest_reserve_version"),
    )
    return f.unionByName(h).agg(
        F.max("field_rows").alias("field_rows"),
        F.max("reserve_history_rows").alias("reserve_history_rows"),
        F.max("latest_reserve_version").alias("latest_reserve_version"),
    )


# ---------------------------------------------------------------- A5
def count_per_group(df: DataFrame, keys: Sequence[str], counted: str, alias: str) -> DataFrame:
    """``count(col)`` (non-NULL) per group."""
    return df.groupBy(*keys).agg(F.count(counted).cast("bigint").alias(alias))


# ---------------------------------------------------------------- A7 / Q2
def duplicates(df: DataFrame, keys: Sequence[str], count_name: str = "n_copies", extra: Sequence[Column] = ()) -> DataFrame:
    """Key values occurring more than once, with their count and any ``extra``
    aggregates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name), *extra).where(F.col(count_name) > 1)

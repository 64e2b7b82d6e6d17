"""Pageview marts (M5-M7) over a daily table shaped like
``contracts.PAGEVIEWS_DAILY``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import trailing_days
from tablework.operators.aggregates import summarise
from tablework.operators.shape import pivot_wide, sort_key

SUMMARY_KEYS = ("project", "article")
TREND_DAYS = 30  # fixed value: trend window of the dashboard
RECENT_DAYS = 7  # fixed value: "last 7 days" total


def article_summary(daily: DataFrame, as_of: str) -> DataFrame:
    """M5: per (project, article) first/last day, totals, mean, last-7-day
    total (``viewed_on >= as_of - 7``) and latest load time."""
    return summarise(daily, SUMMARY_KEYS, "viewed_on", "views", "loaded_at_utc", as_of, RECENT_DAYS)


def summary_listing(summary: DataFrame) -> DataFrame:
    """Summary rows as the dashboard lists them (dates as text, by total desc)."""
    return summary.select(
        "article",
        "total_views",
        "avg_daily_views",
        "views_last_7_days",
        F.col("first_viewed_on").cast("string").alias("first_viewed_on"),
        F.col("last_viewed_on").cast("string").alias("last_viewed_on"),
        F.col("loaded_at_utc").cast("string").alias("loaded_at_utc"),
    ).orderBy(sort_key("total_views", desc=True), sort_key("article"))


def daily_trend(daily: DataFrame, as_of: str, days: int = TREND_DAYS) -> DataFrame:
    """M6 (long form): rows of the last ``days`` days, by date then article."""
    recent = daily.where(trailing_days("viewed_on", as_of, days))
    return recent.select(
        F.col("viewed_on").cast("string").alias("viewed_on"), "article", "views"
    ).orderBy(sort_key("viewed_on"), sort_key("article"))


def daily_trend_wide(
    daily: DataFrame,
    as_of: str,
    columns: Sequence[str],
    column_key: str = "article",
    days: int = TREND_DAYS,
    how: str = "sum",
) -> DataFrame:
    """M6 (wide form, R1): one row per day, one column per value in
    ``columns`` (the dashboard passes the summary order).  ``how='last'``
    keeps the last load of a repeated (day, key) cell, ``'sum'`` adds them
    (an explicit aggregate, so two projects with the same article do not
    silently overwrite each other)."""
    recent = daily.where(trailing_days("viewed_on", as_of, days))
    if how == "sum":
        wide = recent.groupBy("viewed_on").pivot(column_key, list(columns)).agg(F.sum("views").cast("bigint"))
    else:
        wide = pivot_wide(recent, "viewed_on", column_key, "views", columns, tie="loaded_at_utc")
    return wide.withColumn("viewed_on", F.col("viewed_on").cast("string")).orderBy(sort_key("viewed_on"))


def pageview_kpis(summary: DataFrame) -> DataFrame:
    """M7: totals over the summary, number of rows, the leading article (by
    total views, ties on the smaller article then project name, so the pick
    is deterministic) and *its* load time (not the maximum), as the
    dashboard shows it.  One global aggregate."""
    rank = F.struct(-F.col("total_views"), F.col("article"), F.col("project"))
    return summary.agg(
        F.sum("total_views").cast("bigint").alias("total_views"),
        F.sum("views_last_7_days").cast("bigint").alias("views_last_7_days"),
        F.count(F.lit(1)).cast("bigint").alias("articles"),
        F.min_by("article", rank).alias("leading_article"),
        F.min_by("total_views", rank).cast("bigint").alias("leading_views"),
        F.min_by("loaded_at_utc", rank).alias("leading_loaded_at_utc"),
    )

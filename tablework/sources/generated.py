"""Generated and staged relations.

Series are made with ``explode(sequence(...))`` per input row, so a
"days x metrics" grid is a generator on the metric rows, not a cross
join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _date(as_of: str | Column) -> Column:
    return F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of


def with_day_series(df: DataFrame, as_of: str | Column, n: int, date_col: str = "measured_on", index_col: str = "day_index") -> DataFrame:
    """S5 on every row of ``df``: ``n`` consecutive days ending at ``as_of``;
    day ``i`` (0-based) is ``as_of - (n - 1 - i)``."""
    end = _date(as_of)
    exploded = df.select("*", F.posexplode(F.sequence(F.date_sub(end, n - 1), end)).alias(index_col, date_col))
    return exploded.withColumn(index_col, F.col(index_col).cast("int"))


def day_series(spark: SparkSession, as_of: str, n: int) -> DataFrame:
    """S5 alone: ``range(n)`` turned into dates ending at ``as_of``."""
    return spark.range(n).select(
        F.date_sub(F.to_date(F.lit(as_of)), (F.lit(n - 1) - F.col("id")).cast("int")).alias("measured_on"),
        F.col("id").cast("int").alias("day_index"),
    )


def values_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """An inline VALUES relation."""
    return spark.createDataFrame(list(rows), schema)


def stage_rows(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str, view: str) -> DataFrame:
    """Typed staging of driver-side rows as a temp view; empty input is
    an error (a source that returns nothing must not empty a table)."""
    if not rows:
        raise ValueError(f"no rows to stage into {view}")
    df = spark.createDataFrame(list(rows), schema)
    df.createOrReplaceTempView(view)
    return df

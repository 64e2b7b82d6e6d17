"""Global positions of rows by range counts: numbering a total order and
reading pages deep inside it, without gathering the rows in one task.

The rows are range-partitioned on the order once, sorted and numbered there,
and written to the shared checkpoint folder, one folder per range.  The counts
of the ranges (one row each) give the position of every range's first row.  A
range holds about ``RANGE_ROWS`` rows however many there are, so a task sorts a
bounded number, and nothing moves again to be numbered.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablework.session import checkpoint_dir

_PART = "__range"
_PLACE = "__place"  # of a row in its range, from 0

RANGE_ROWS = 250_000


def parts_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions of about ``RANGE_ROWS`` rows; None where the session's own
    number of them is enough."""
    n = -(-rows // RANGE_ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


class Ranges:
    """``df`` in ranges of its total order ``order`` (sort columns; add a unique
    one last, equal keys share a range and are numbered arbitrarily).  ``rows``
    is about how many there are, where that is known."""

    def __init__(self, df: DataFrame, order: Sequence[Column], rows: int | None = None):
        spark = df.sparkSession
        path = f"{checkpoint_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
        self.order = list(order)
        self.parts = parts_for(spark, df.count() if rows is None else rows)
        dealt = df.repartitionByRange(self.parts, *self.order) if self.parts else df.repartitionByRange(*self.order)
        # sorted by the range first, which is the order the folders are written in
        inside = dealt.withColumn(_PART, F.spark_partition_id()).sortWithinPartitions(_PART, *self.order)
        # the low 33 bits count the rows of a task
        parts = inside.withColumn(_PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        parts.write.partitionBy(_PART).parquet(path)
        self.rows = spark.read.schema(parts.schema).parquet(path)
        along = Window.orderBy(_PART)
        counts = self.rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
        # one row per range
        self.starts = counts.select(_PART, (F.sum("__n").over(along) - F.col("__n")).alias("__before"), "__n")

    def numbered(self, name: str = "rank") -> DataFrame:
        """All rows with their position, from 1."""
        return self._number(self.rows, name)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` + 1 to ``offset`` + ``limit``, in order; only the
        ranges that hold them are read."""
        met = self.starts.where((F.col("__before") < offset + limit) & (F.col("__before") + F.col("__n") > offset))
        wanted = [r[0] for r in met.select(_PART).collect()]  # the ranges of one page
        inside = self._number(self.rows.where(F.col(_PART).isin(wanted)), "__at").where((F.col("__at") > offset) & (F.col("__at") <= offset + limit))
        return inside.orderBy("__at").drop("__at")

    def _number(self, rows: DataFrame, name: str) -> DataFrame:
        numbered = rows.join(F.broadcast(self.starts), _PART)
        return numbered.withColumn(name, F.col(_PLACE) + F.col("__before") + 1).drop(_PART, _PLACE, "__before", "__n")

"""Keyed upsert into a plain parquet table of Spark's catalog.

The table is partitioned by a value of each row (a month, say) and bucketed
and sorted by its key.  An upsert reads the partitions that the incoming rows
touch, joins them with the incoming rows on the key in one full outer join and
overwrites exactly these partitions (dynamic partition overwrite).  The
stored side is read in its buckets, so only the incoming rows are shuffled.

Spark writes the new partitions beside the table and moves them in when the
job commits, so a lost executor or a failed job leaves the table as it was.
Two writers at once, or a driver lost while the partitions are moved, need a
transactional table format below the same calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablework.operators.quality import assert_unique


def upsert_join(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J4 + X2 as one full outer join: ``incoming`` rows replace ``target``
    rows of the same key, other rows stay.  Keys are unique on both sides;
    NULL keys match nothing.  Each side is read once."""
    cols = target.columns
    new = incoming.select(*[F.col(c).alias(f"__new_{c}") for c in cols], F.lit(True).alias("__new"))
    on = [F.col(k) == F.col(f"__new_{k}") for k in keys]
    joined = target.join(new, on, "full_outer")
    return joined.select(*[F.when(F.col("__new"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


class KeyedTable:
    """A table of ``schema`` at ``path`` with the unique key ``keys``,
    partitioned by ``part`` (computed from a row) into ``buckets`` buckets.

    The data at ``path`` outlives the session: a table of an earlier run is
    registered again under ``name`` and its partitions are found."""

    def __init__(self, spark: SparkSession, name: str, path: str, schema: StructType, keys: Sequence[str], part: Column, part_name: str = "part", buckets: int = 8):
        self.spark, self.name, self.keys, self.part, self.part_name, self.schema = spark, name, list(keys), part, part_name, schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        key = ", ".join(f"`{k}`" for k in keys)
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE `{name}` ({columns}, `{part_name}` string) USING parquet PARTITIONED BY (`{part_name}`) "
                f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
            try:
                spark.read.schema(schema).parquet(path)
            except AnalysisException as exc:  # a new table
                if exc.getCondition() != "PATH_NOT_FOUND":
                    raise
            else:
                spark.sql(f"ALTER TABLE `{name}` RECOVER PARTITIONS")

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.schema.fieldNames())

    def upsert_plan(self, incoming: DataFrame, parts: Sequence[str]) -> DataFrame:
        """The new rows of the partitions ``parts``."""
        target = self.spark.table(self.name).where(F.col(self.part_name).isin(list(parts)))
        return upsert_join(target, incoming, self.keys)

    def upsert(self, incoming: DataFrame) -> list[str]:
        """Write ``incoming`` (unique on the key, which determines ``part``);
        returns the partitions that were rewritten."""
        rows = incoming.select(*self.schema.fieldNames(), self.part.cast("string").alias(self.part_name))
        assert_unique(rows, self.keys)
        parts = sorted(r[0] for r in rows.select(self.part_name).distinct().collect())  # a few months
        if parts:
            mode = "spark.sql.sources.partitionOverwriteMode"
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                self.upsert_plan(rows, parts).write.insertInto(self.name, overwrite=True)
            finally:
                self.spark.conf.set(mode, before)
        return parts

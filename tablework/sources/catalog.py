"""Named tables and the catalog inventory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_tables(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> None:
    """Expose parquet tables under their names (lazy temp views)."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def catalog_inventory(spark: SparkSession, names: Sequence[str] | None = None, schema_name: str = "main") -> DataFrame:
    """Tables LEFT JOIN their columns on (schema, name), grouped,
    with the count of columns (0 for a table without columns).

    The catalog listing is metadata (one row per table and column); the
    inventory itself is the same join + aggregate a SQL user writes over
    information_schema.
    """
    tables = [t for t in spark.catalog.listTables() if names is None or t.name in names]
    t_rows = [(schema_name, t.name, "VIEW" if t.isTemporary else "BASE TABLE") for t in tables]
    c_rows = [(schema_name, t.name, c.name) for t in tables for c in spark.catalog.listColumns(t.name)]
    t_df = spark.createDataFrame(t_rows, "table_schema string, table_name string, table_type string")
    c_df = spark.createDataFrame(c_rows, "table_schema string, table_name string, column_name string")
    inv = t_df.join(c_df, ["table_schema", "table_name"], "left")
    return inv.groupBy("table_schema", "table_name", "table_type").agg(F.count("column_name").cast("bigint").alias("column_count"))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """A6 on the inventory: number of distinct schemas and total columns."""
    return inventory.agg(
        F.count_distinct("table_schema").cast("bigint").alias("schemas"),
        F.sum("column_count").cast("bigint").alias("columns"),
        F.count(F.lit(1)).cast("bigint").alias("tables"),
    )


def run_sql(spark: SparkSession, sql: str, args: Mapping[str, object] | Sequence[object] | None = None) -> DataFrame:
    """Parameterised SQL (named ``:name`` or positional ``?`` markers)."""
    return spark.sql(sql, args=args) if args is not None else spark.sql(sql)


def set_variables(spark: SparkSession, values: Mapping[str, object]) -> None:
    """S10 session variables: ``DECLARE OR REPLACE VARIABLE`` per name,
    then the value via a parameter marker (never spliced into the text).
    SQL reads them by name, e.g. ``WHERE c_nationkey = nation_filter``."""
    for name, value in values.items():
        if not name.isidentifier():
            raise ValueError(f"invalid variable name {name!r}")
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} = :value", args={"value": value})

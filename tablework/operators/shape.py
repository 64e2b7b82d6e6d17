"""Sorts, top-k, set operations and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.operators.ranges import Ranges


# ---------------------------------------------------------------- T1 / T2
def sort_key(column: str | Column, desc: bool = False) -> Column:
    """Explicit NULL placement (DuckDB puts NULLs last in both directions)."""
    c = F.col(column) if isinstance(column, str) else column
    return c.desc_nulls_last() if desc else c.asc_nulls_last()


def top_k(df: DataFrame, by: str | Column, k: int, desc: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Top ``k`` rows by ``by`` with ascending tie-break columns.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps
    its own k best rows, so only ``k x tasks`` rows reach the final merge.
    """
    return df.orderBy(sort_key(by, desc), *[sort_key(t) for t in tie]).limit(k)


def total_sort(df: DataFrame, *keys: tuple[str, bool] | str) -> DataFrame:
    """T2 with explicit NULL placement; ``keys`` are names or (name, desc)."""
    cols = [sort_key(k) if isinstance(k, str) else sort_key(k[0], k[1]) for k in keys]
    return df.orderBy(*cols)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Bounded listing (LIMIT/OFFSET over a total order).  The first page
    is a top-k; further ones are located by the row counts of ranges of the
    order, so no task sorts what comes before the page."""
    return Ranges(df, order).page(limit, offset) if offset else df.orderBy(*order).limit(limit)


# ---------------------------------------------------------------- X1
def reconcile_members(
    desired: DataFrame,
    current: DataFrame,
    keys: Sequence[str],
    mode: str = "authoritative",
    kind_col: str | None = None,
    direct_col: str | None = None,
) -> DataFrame:
    """GRANT rows for desired - current; REVOKE rows for current - desired in
    ``authoritative`` mode (``additive`` keeps extras).

    ``kind_col`` (e.g. grantee type) is compared case-insensitively;
    ``direct_col`` keeps only direct current memberships (inherited ones
    are never revoked).  Two anti joins on the member key; both inputs are
    de-duplicated by a hash aggregate first, so duplicate rows never
    multiply.
    """
    if mode not in ("authoritative", "additive"):
        raise ValueError("mode must be authoritative or additive")
    if direct_col:
        current = current.where(F.coalesce(F.col(direct_col), F.lit(False)))
    if kind_col:
        desired = desired.withColumn(kind_col, F.lower(kind_col))
        current = current.withColumn(kind_col, F.lower(kind_col))
    d = desired.select(*keys).distinct()
    c = current.select(*keys).distinct()
    grants = d.join(c, list(keys), "left_anti").withColumn("action", F.lit("GRANT"))
    if mode == "additive":
        return grants
    revokes = c.join(d, list(keys), "left_anti").withColumn("action", F.lit("REVOKE"))
    return grants.unionByName(revokes)


# ---------------------------------------------------------------- X3
def distinct_union(dfs: Sequence[DataFrame]) -> DataFrame:
    """UNION (distinct) of several selections with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


# ---------------------------------------------------------------- R1
def pivot_wide(
    df: DataFrame,
    row: str,
    col: str,
    val: str,
    values: Sequence[str],
    tie: str | None = None,
) -> DataFrame:
    """Long-to-wide pivot: one row per ``row``, one column per value of
    ``col``; a missing cell is NULL.  A repeated (row, col) keeps the value
    of the last row under ``tie`` (``max_by``), so repeats are
    deterministic.  ``values`` must be given: without them Spark runs an
    extra distinct job to discover the columns.
    """
    agg = F.max_by(val, tie) if tie else F.max(val)
    return df.groupBy(row).pivot(col, list(values)).agg(agg)

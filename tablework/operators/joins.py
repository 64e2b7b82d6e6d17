"""Joins that need more than ``df.join``.

J1 (left equi join), J2 (a grid, built as a generator) and J4 (semi/anti
join) are plain DataFrame calls at their use sites.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_ancestors(path: Column, sep: str = "/") -> Column:
    """The path itself and every ancestor directory, as an array."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))


def prefix_join(files: DataFrame, owners: DataFrame, path_col: str = "path", dir_col: str = "dir") -> DataFrame:
    """(file, owner) pairs where the file equals the owner's directory
    or lies below it (``startswith(dir + '/')``).

    Each path is exploded into its ancestors and equi-joined with the
    owner directories, so the theta condition becomes a hash join (no
    nested loop); the output is the matching pairs only.
    """
    anc = files.select("*", F.explode(path_ancestors(F.col(path_col))).alias("__anc"))
    return anc.join(owners, anc["__anc"] == owners[dir_col], "inner").drop("__anc")


def selected_owners(
    files: DataFrame,
    owners: DataFrame,
    global_patterns: Sequence[str],
    path_col: str = "path",
    dir_col: str = "dir",
    has_base: bool = True,
) -> DataFrame:
    """Owners affected by a change set: no base -> every owner; a file equal
    to or starting with a global pattern -> every owner; otherwise owners
    with a file under their directory.  An empty change set selects none
    (the join simply finds nothing)."""
    if not has_base:
        return owners
    is_global = reduce(lambda a, b: a | b, [F.col(path_col).startswith(p) for p in global_patterns], F.lit(False))
    any_global = files.where(is_global).limit(1).count() > 0
    if any_global:
        return owners
    hit = prefix_join(files.select(path_col), owners.select(dir_col), path_col, dir_col).select(dir_col).distinct()
    return owners.join(hit, dir_col, "left_semi")


def multi_key_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on several key columns."""
    return left.join(right, list(keys), "left")

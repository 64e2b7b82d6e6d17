"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# Scope-guard messages (pieces around type, verb and name).
GUARD_PRODUCTION = ("refusing to delete preview ", " because it matches production: ")
GUARD_UNSCOPED = ("refusing to ", " preview ", " without branch slug ")


def resolve_choice(choice: str | None, allowed: Sequence[str], all_value: str) -> str:
    """An unknown choice falls back to the ALL value (driver-side, tiny)."""
    return choice if choice in allowed else all_value


def choice_predicate(choices: Mapping[str, tuple[str | None, Sequence[str], str]]) -> Column:
    """AND of ``col = choice`` for every column whose (validated) choice is
    not the ALL value; ALL contributes TRUE, which Catalyst folds away."""
    preds = []
    for column, (choice, allowed, all_value) in choices.items():
        picked = resolve_choice(choice, allowed, all_value)
        if picked != all_value:
            preds.append(F.col(column) == F.lit(picked))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def choice_filter(df: DataFrame, choices: Mapping[str, tuple[str | None, Sequence[str], str]]) -> DataFrame:
    """Choice-validated conjunctive filter."""
    return df.where(choice_predicate(choices))


def scope_guard(
    df: DataFrame,
    name_col: str,
    markers: Sequence[str],
    production: DataFrame | None = None,
    key_cols: Sequence[str] = (),
    production_col: str = "production_name",
    type_col: str | None = "type",
) -> DataFrame:
    """P10: add ``guard_error`` to rows whose name must not be touched.

    A row is refused when its name equals the production name of the same
    resource (``production`` joined on ``key_cols``; with no key columns,
    any production name), or when it contains none of the non-empty
    branch ``markers`` (the first marker is the branch slug named in the
    message).  Shares and databases are "dropped", the rest "deleted".
    """
    live_markers = [m for m in markers if m]
    slug = live_markers[0] if live_markers else ""
    typ = F.col(type_col) if type_col else F.lit("resource")
    name = F.col(name_col)
    if production is not None:
        # a row per key and name, so that a key with several production names adds no rows
        prod = production.select(*key_cols, F.col(production_col).alias("__prod")).distinct()
        same = [df[k] == prod[k] for k in key_cols] + [name == prod["__prod"]]
        joined = df.join(prod, same, "left").select(*[df[c] for c in df.columns], prod["__prod"])
        matches = F.col("__prod").isNotNull()
    else:
        joined = df.withColumn("__prod", F.lit(None).cast("string"))
        matches = F.lit(False)
    has_marker = reduce(lambda a, b: a | b, [name.contains(m) for m in live_markers], F.lit(False))
    verb = F.when(typ.isin("share", "database"), F.lit("drop")).otherwise(F.lit("delete"))
    reason = F.when(matches, F.concat(F.lit(GUARD_PRODUCTION[0]), typ, F.lit(GUARD_PRODUCTION[1]), name)).when(
        ~has_marker, F.concat(F.lit(GUARD_UNSCOPED[0]), verb, F.lit(GUARD_UNSCOPED[1]), typ, F.lit(GUARD_UNSCOPED[2] + slug))
    )
    return joined.withColumn("guard_error", reason).drop("__prod")

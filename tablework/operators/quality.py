"""Data-quality checks as tables of violations (Q1-Q7).

Row rules become columns: every rule is a ``when(fails, struct(...))``
element of one array, NULLs are filtered out and the rest exploded, so a
whole rule set costs one narrow pass with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablework.operators.aggregates import duplicates


class ContractError(ValueError):
    """The data does not satisfy its column contract."""


class EmptySourceError(RuntimeError):
    """A source returned no rows."""


@dataclass(frozen=True)
class Rule:
    """One row rule.

    kinds: ``required`` (not NULL and not ''), ``type`` (value of JSON type
    ``arg``: integer, number, boolean, string), ``const`` (equals ``arg``), ``enum`` (in ``arg``),
    ``min_length`` (length >= ``arg``), ``pattern`` (whole-string regex
    ``arg``), ``min_items`` (array size >= ``arg``), ``exactly_one`` /
    ``at_most_one`` (of the columns in ``arg``), ``requires`` (when
    ``column`` is set, all of ``arg`` must be set), ``implies`` (``arg`` =
    (value, other column, other value): the value needs the other value).
    """

    kind: str
    column: str
    arg: object = None
    message: str | None = None
    extra: dict = field(default_factory=dict)


def _is_set(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != F.lit(""))


# Text forms accepted for JSON-schema style value types.
TYPE_PATTERNS = {
    "integer": "-?[0-9]+(\\.0+)?",
    "number": "-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?",
    "boolean": "(?i)true|false",
    "string": "(?s).*",
}


def _type_ok(text: Column, type_name: str) -> Column:
    """Whether the text form of a value is of the JSON-schema style type."""
    return text.rlike("\\A(?:" + TYPE_PATTERNS[type_name] + ")\\z")


def _rule_fails(rule: Rule) -> tuple[Column, str]:
    c = F.col(rule.column)
    k, a = rule.kind, rule.arg
    if k == "required":
        return ~_is_set(c), f"{rule.column} is required"
    if k == "type":
        return c.isNotNull() & ~_type_ok(c.cast("string"), str(a)), f"{rule.column} must be of type {a}"
    if k == "const":
        return c.isNotNull() & (c != F.lit(a)), f"{rule.column} must equal {a!r}"
    if k == "enum":
        return c.isNotNull() & ~c.isin(list(a)), f"{rule.column} must be one of {', '.join(map(str, a))}"
    if k == "min_length":
        return c.isNotNull() & (F.length(c) < F.lit(int(a))), f"{rule.column} must have at least {a} characters"
    if k == "pattern":
        return c.isNotNull() & ~c.rlike(str(a)), f"{rule.column} must match {a}"
    if k == "min_items":
        return c.isNotNull() & (F.size(c) < F.lit(int(a))), f"{rule.column} must have at least {a} items"
    if k in ("exactly_one", "at_most_one"):
        cols = list(a)
        n_set = reduce(lambda x, y: x + y, [_is_set(F.col(x)).cast("int") for x in cols])
        if k == "exactly_one":
            return n_set != F.lit(1), f"exactly one of {', '.join(cols)} is required"
        return n_set > F.lit(1), f"at most one of {', '.join(cols)} may be set"
    if k == "implies":
        value, other, other_value = a
        return (c == F.lit(value)) & ~F.coalesce(F.col(other) == F.lit(other_value), F.lit(False)), f"{rule.column} {value} requires {other} {other_value}"
    if k == "requires":
        needs = list(a)
        missing = reduce(lambda x, y: x | y, [~_is_set(F.col(x)) for x in needs])
        return _is_set(c) & missing, f"{rule.column} requires {', '.join(needs)}"
    raise ValueError(f"unknown rule kind {k}")


def check_rows(df: DataFrame, rules: Sequence[Rule], id_cols: Sequence[str]) -> DataFrame:
    """Q1/Q4: one output row per (input row, failed rule) with the rule
    kind, the checked column (path) and a message."""
    checks = []
    for r in rules:
        fails, msg = _rule_fails(r)
        checks.append(
            F.when(
                F.coalesce(fails, F.lit(False)),
                F.struct(F.lit(r.kind).alias("rule"), F.lit(r.column).alias("path"), F.lit(r.message or msg).alias("message")),
            )
        )
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(*id_cols, F.explode(arr).alias("v")).select(*id_cols, "v.rule", "v.path", "v.message")


def check_unique(df: DataFrame, keys: Sequence[str], count_name: str = "n_rows") -> DataFrame:
    """Q2: key values that occur more than once (partial aggregate first)."""
    return duplicates(df, keys, count_name)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Q2 as a gate: raise when a key repeats (one tiny driver read)."""
    dup = check_unique(df, keys).limit(1).collect()
    if dup:
        raise ContractError(f"duplicate key {tuple(dup[0][k] for k in keys)} for ({', '.join(keys)})")


def check_references(
    child: DataFrame,
    parent: DataFrame,
    child_keys: Sequence[str],
    parent_keys: Sequence[str],
    planned: DataFrame | None = None,
) -> DataFrame:
    """Child rows whose reference resolves to no parent row; names
    planned in the same run (``planned``, same columns as ``parent_keys``)
    count as existing."""
    existing = parent.select(*parent_keys)
    if planned is not None:
        existing = existing.unionByName(planned.select(*parent_keys))
    existing = existing.distinct()
    cond = reduce(lambda a, b: a & b, [child[c] == existing[p] for c, p in zip(child_keys, parent_keys)])
    return child.join(existing, cond, "left_anti")


def check_contract(schema: StructType, contract: Iterable[tuple[str, str, str]] | Sequence[str], closed: bool = False) -> list[str]:
    """Q5: problems of ``schema`` against the expected source columns.
    Returns a list of messages (empty when fine)."""
    expected = [c if isinstance(c, str) else c[0] for c in contract]
    present = set(schema.fieldNames())
    problems = [f"missing column {c}" for c in expected if c not in present]
    if closed:
        problems += [f"unknown column {c}" for c in schema.fieldNames() if c not in set(expected)]
    return problems


def check_contract_keys(present: set[str], expected: Sequence[str], closed: bool = False) -> None:
    """Q5 gate on a set of keys present in the data."""
    missing = [c for c in expected if c not in present]
    extra = sorted(present - set(expected)) if closed else []
    if missing or extra:
        parts = []
        if missing:
            parts.append("missing column(s): " + ", ".join(missing))
        if extra:
            parts.append("unknown column(s): " + ", ".join(extra))
        raise ContractError("; ".join(parts))


def require_rows(df: DataFrame, what: str = "source") -> DataFrame:
    """Q6: zero rows is an error, not an empty table."""
    if df.isEmpty():
        raise EmptySourceError(f"{what} returned no rows")
    return df


def check_separation(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Q7: (key, column, value) where the same key in both sets shares an
    identifier value in that column; two absent values (NULL) are equal.

    Each side is first reduced to its distinct (key, column, value)
    triples (a partial aggregate), then the triples are equi-joined, so a
    key repeated on both sides never multiplies into all pairs.
    """

    def triples(df: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("shared_value")) for c in cols])
        return df.select(*keys, F.inline(cells)).distinct()

    left, right = triples(a).alias("l"), triples(b).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*keys, "column")]
    joined = left.join(right, [*same, F.col("l.shared_value").eqNullSafe(F.col("r.shared_value"))], "inner")
    return joined.select(*[F.col(f"l.{c}") for c in (*keys, "column", "shared_value")])

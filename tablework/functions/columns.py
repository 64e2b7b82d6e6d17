"""Column expressions (scalar functions and predicates).

All helpers return ``pyspark.sql.Column`` built from built-in functions,
so they stay inside whole-stage codegen; none of them touches Python per
row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- P5
def blank_eq(column: ColumnOrName, value: str | None) -> Column:
    """An empty wanted value matches NULL or ''; otherwise plain equality."""
    if value is None or value == "":
        return F.coalesce(_c(column), F.lit("")) == F.lit("")
    return _c(column) == F.lit(value)


# ---------------------------------------------------------------- P6
def guarded_ratio(num: ColumnOrName, den: ColumnOrName, when: Column | None = None) -> Column:
    """``100 * num / den`` only when ``den > 0``, ``num`` is not NULL and the
    optional extra condition holds; NULL otherwise (also avoids the ANSI
    divide-by-zero error)."""
    cond = (_c(den) > 0) & _c(num).isNotNull()
    if when is not None:
        cond = when & cond
    return F.when(cond, F.lit(100.0) * _c(num) / _c(den))


# ---------------------------------------------------------------- P7
def clamp_pct(total: ColumnOrName, left: ColumnOrName) -> Column:
    """Share of ``total`` already used: ``100*(total-coalesce(left,0))/total``
    clamped to [0, 100]; NULL unless ``total > 0``."""
    share = F.lit(100.0) * (_c(total) - F.coalesce(_c(left), F.lit(0.0))) / _c(total)
    return F.when(_c(total) > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)))


# ---------------------------------------------------------------- P8
def nonneg_diff(a: ColumnOrName, b: ColumnOrName | None = None) -> Column:
    """``greatest(coalesce(a,0) - coalesce(b,0), 0)``; with one argument
    ``greatest(coalesce(a,0), 0)``."""
    value = F.coalesce(_c(a), F.lit(0.0))
    if b is not None:
        value = value - F.coalesce(_c(b), F.lit(0.0))
    return F.greatest(value, F.lit(0.0))


# ---------------------------------------------------------------- P9 / F3
def newest(*cols: ColumnOrName) -> Column:
    """NULL-skipping greatest of several timestamps."""
    return F.greatest(*[_c(c) for c in cols])


# ---------------------------------------------------------------- P3 / F6
def trailing_days(column: ColumnOrName, as_of: str | Column, n: int) -> Column:
    """``column >= as_of - n days`` (inclusive, as in the reference)."""
    anchor = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return _c(column) >= F.date_sub(anchor, n)


# ---------------------------------------------------------------- F1
def from_epoch_ms(column: ColumnOrName, as_date: bool = False) -> Column:
    """NULL-safe epoch milliseconds to timestamp (UTC session) or date."""
    ts = F.timestamp_millis(_c(column).cast("bigint"))
    return ts.cast("date") if as_date else ts


# ---------------------------------------------------------------- F5
def fmt_utc(column: ColumnOrName) -> Column:
    """``yyyy-MM-dd HH:mm UTC`` text of a timestamp (session zone is UTC)."""
    return F.date_format(_c(column), "yyyy-MM-dd HH:mm 'UTC'")


def tstz_text(column: ColumnOrName) -> Column:
    """Text form of a UTC timestamp the way a TIMESTAMPTZ prints (``+00``)."""
    return F.concat(F.date_format(_c(column), "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))


# ---------------------------------------------------------------- F7
def split_list(column: ColumnOrName, sep: str = ",") -> Column:
    """Split on ``sep``, trim each part (any white space) and drop blanks."""
    parts = F.transform(F.split(_c(column), sep), lambda x: F.regexp_replace(x, "\\A\\s+|\\s+\\z", ""))
    return F.filter(parts, lambda x: x != F.lit(""))


def required_list(column: ColumnOrName, what: str, sep: str = ",") -> Column:
    """:func:`split_list` that fails the query where nothing is left."""
    parts = split_list(column, sep)
    return F.when(F.size(parts) > 0, parts).otherwise(F.raise_error(F.lit(f"{what} must name at least one entry")))


# ---------------------------------------------------------------- F8
SLUG_MAX = 48  # fixed value: slug length limit
SLUG_EMPTY = "preview"  # fixed value: slug of an empty name


def branch_slug(column: ColumnOrName) -> Column:
    """Lower-case, runs of non ``[a-z0-9]`` become ``_``, strip ``_``, keep
    the first 48 characters (after the strip, so a slug may end in
    ``_``); an empty result becomes ``preview``."""
    squashed = F.regexp_replace(F.lower(_c(column)), "[^a-z0-9]+", "_")
    stripped = F.regexp_replace(squashed, "^_+|_+$", "")
    cut = F.substring(stripped, 1, SLUG_MAX)
    return F.when(cut == F.lit(""), F.lit(SLUG_EMPTY)).otherwise(cut)


# ---------------------------------------------------------------- F9
def metric_label(column: ColumnOrName) -> Column:
    """Underscores become spaces."""
    return F.replace(_c(column), F.lit("_"), F.lit(" "))


# ---------------------------------------------------------------- F10
def full_match(column: ColumnOrName, pattern: str) -> Column:
    """Whole-string regex match."""
    return _c(column).rlike("\\A(?:" + pattern + ")\\z")


def drop_lines(column: ColumnOrName, contains_pattern: str) -> Column:
    """Remove every whole line (with its newline) that contains a match of
    ``contains_pattern``; only ``\\n`` ends a line.

    One global replace of ``^[^\\n]*(?:pattern)[^\\n]*\\n?`` in multi-line
    mode with UNIX_LINES (``(?d)``, so ``^`` only follows ``\\n``).  The
    ``^`` anchor makes every attempt start at a line start, which keeps the
    match linear in the text length (an unanchored pattern retries from
    every position of a long line).  Texts without any match skip the
    rewrite (a plain ``rlike`` scan decides).
    """
    text = _c(column)
    rewritten = F.regexp_replace(text, "(?d)(?m)^[^\\n]*(?:" + contains_pattern + ")[^\\n]*\\n?", "")
    return F.when(text.rlike(contains_pattern), rewritten).otherwise(text)


# ---------------------------------------------------------------- F11
def join_pair(a: ColumnOrName, b: ColumnOrName, sep: str = "|") -> Column:
    return F.concat_ws(sep, _c(a), _c(b))


def split_first(column: ColumnOrName, sep: str = "|") -> tuple[Column, Column]:
    """Split at the first separator: (head, rest)."""
    pos = F.instr(_c(column), sep)
    head = F.when(pos > 0, _c(column).substr(F.lit(1), pos - 1)).otherwise(_c(column))
    rest = F.when(pos > 0, _c(column).substr(pos + len(sep), F.length(_c(column))))
    return head, rest


# ---------------------------------------------------------------- F12
def string_array(values: Iterable[str]) -> Column:
    """Typed ``array<string>`` literal (typed even when empty)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def string_map(keys: Iterable[str], values: Iterable[str]) -> Column:
    """Typed ``map<string,string>`` literal (typed even when empty)."""
    return F.map_from_arrays(string_array(keys), string_array(values)).cast("map<string,string>")


# ---------------------------------------------------------------- F13
def json_field(column: ColumnOrName, path: str) -> Column:
    return F.get_json_object(_c(column), path)


# ---------------------------------------------------------------- F14
def load_time() -> str:
    """Now in UTC cut to the second, as text: computed once on the driver
    and passed to every query of a run as a literal (never
    ``current_timestamp`` per query), so all tables of a load agree."""
    import datetime as _dt

    return _dt.datetime.now(_dt.timezone.utc).replace(microsecond=0, tzinfo=None).isoformat(sep=" ")

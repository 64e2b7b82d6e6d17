"""JSON and text sources.

Sources never pass data through the driver.  Contract checks (Q5) run on
the *set of keys present* in the data: for typed scans that is the schema
Spark infers over all files, for page payloads a distributed ``distinct``
over ``map_keys`` of the attribute objects (bounded by the number of
distinct keys).  A column that is absent everywhere fails the load, like
a binder error; a column that is present but NULL does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType, StructField, StructType

from tablework.contracts import Contract, source_schema
from tablework.functions.columns import drop_lines
from tablework.operators.quality import ContractError, check_contract_keys
from tablework.operators.ranges import Ranges


class PageError(RuntimeError):
    """A landed API page is inconsistent (error payload, bad shape, ...)."""


def project(df: DataFrame, contract: Contract, epoch_ts: Sequence[str] = (), epoch_date: Sequence[str] = ()) -> DataFrame:
    """``src::TYPE AS dst`` for every contract entry (strict ANSI casts),
    then epoch-millisecond columns to timestamp or date (F1)."""
    cols = []
    for src, typ, dst in contract:
        c = F.col(f"`{src}`").cast(typ)
        if dst in epoch_ts:
            c = F.timestamp_millis(c.cast("bigint"))
        elif dst in epoch_date:
            c = F.timestamp_millis(c.cast("bigint")).cast("date")
        cols.append(c.alias(dst))
    return df.select(*cols)


def _present_keys(df: DataFrame, json_col: Column) -> set[str]:
    """Distinct top-level keys of a JSON-object column (tiny result)."""
    keys = df.select(F.explode(F.map_keys(F.from_json(json_col, "map<string,string>"))).alias("k")).distinct()
    return {r["k"] for r in keys.collect()}


def read_json_table(
    spark: SparkSession,
    path: str | Sequence[str],
    contract: Contract,
    epoch_ts: Sequence[str] = (),
    epoch_date: Sequence[str] = (),
    multiline: bool = True,
) -> DataFrame:
    """Typed scan of JSON arrays (``multiline``) or JSON lines of flat
    objects, like an auto-detecting JSON read followed by explicit casts.

    Spark infers the column names over all files (a distributed pass whose
    result is the union of keys present), the contract check runs on that
    schema, then every column is cast and renamed.  A missing source column
    or an uncastable value fails the load (ANSI casts raise).
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("multiLine", multiline).option("mode", "FAILFAST").json(paths)
    check_contract_keys(set(raw.columns), [src for src, _, _ in contract])
    return project(raw, contract, epoch_ts, epoch_date)


# ---------------------------------------------------------------- S2
_FALSY = ("", "false", "0", "null", "{}", "[]", '""')


def unnest_pages(
    pages: DataFrame,
    contract: Contract,
    array_col: str = "features",
    struct_col: str = "attributes",
    more_col: str = "exceededTransferLimit",
    error_col: str = "error",
) -> DataFrame:
    """Landed API pages (one row per page; payload columns either raw
    JSON text or parsed by the JSON reader) to one row per feature
    ``attributes`` object, typed by ``contract`` (source names).

    Non-object features and features without an object ``attributes`` are
    dropped; a missing ``features`` is an empty list.  Page-level errors
    (truthy ``error``, ``features`` that is not a list, a page claiming
    more data with no kept rows, no rows at all) are computed in one
    aggregate over the pages and raised on the driver.
    """
    staged = _staged(pages, array_col, struct_col, more_col, error_col)
    _check_pages(staged, array_col)
    return _typed(staged.select(F.explode("__attrs").alias("obj")), contract)


def _staged(pages: DataFrame, array_col: str, struct_col: str, more_col: str, error_col: str, *others: str) -> DataFrame:
    """(__err, __is_list, __more, __attrs) of each page, and other columns."""
    types = {f.name: f.dataType for f in pages.schema.fields}

    def as_json_text(name: str) -> Column:
        # raw JSON text when read as string, else serialise the parsed value
        return F.col(name) if isinstance(types[name], StringType) else F.to_json(F.col(name))

    feats = F.coalesce(as_json_text(array_col), F.lit("[]")) if array_col in types else F.lit("[]")
    err = as_json_text(error_col) if error_col in types else F.lit(None).cast("string")
    more = F.coalesce(F.col(more_col).cast("boolean"), F.lit(False)) if more_col in types else F.lit(False)
    is_list = F.trim(feats).startswith("[")
    # a payload that is cut off fails the load instead of vanishing
    elems = F.from_json(F.when(is_list, feats), "array<string>", {"mode": "FAILFAST"})
    kept = F.filter(
        F.transform(
            F.filter(elems, lambda e: F.trim(e).startswith("{")),
            lambda e: F.get_json_object(e, f"$.{struct_col}"),
        ),
        lambda a: a.isNotNull() & F.trim(a).startswith("{"),
    )
    return pages.select(*others, err.alias("__err"), is_list.alias("__is_list"), more.alias("__more"), kept.alias("__attrs"))


def _check_pages(staged: DataFrame, array_col: str) -> None:
    n_kept = F.coalesce(F.size("__attrs"), F.lit(0))
    check = staged.agg(
        F.count_if(F.col("__err").isNotNull() & ~F.trim("__err").isin(*_FALSY)).alias("errors"),
        F.count_if(~F.col("__is_list")).alias("not_list"),
        F.count_if(F.col("__more") & (n_kept == 0)).alias("empty_more"),
        F.sum(n_kept).alias("rows"),
        F.first(F.when(F.col("__err").isNotNull() & ~F.trim("__err").isin(*_FALSY), F.col("__err")), ignorenulls=True).alias("first_error"),
    ).first()
    if check["errors"]:
        raise PageError(f"API error: {check['first_error']}")
    if check["not_list"]:
        raise PageError(f"{array_col} is not a list on {check['not_list']} page(s)")
    if check["empty_more"]:
        raise PageError("a page indicated more data but returned no rows")
    if not check["rows"]:
        raise PageError("pages returned no rows")


def _typed(attrs: DataFrame, contract: Contract, *others: str) -> DataFrame:
    """The attribute objects ``obj`` as typed columns."""
    check_contract_keys(_present_keys(attrs, F.col("obj")), [src for src, _, _ in contract])
    schema = source_schema(contract)
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    rows = attrs.select(*others, F.from_json("obj", texts, {"mode": "FAILFAST"}).alias("r")).select(*others, "r.*")
    return rows.select(*others, *[strict_value(f.name, f.dataType).alias(f.name) for f in schema.fields])


def stitch_pages(
    pages: DataFrame,
    contract: Contract,
    id_field: str,
    offset_col: str = "resultOffset",
    series_col: str | None = None,
    landed_col: str | None = None,
    array_col: str = "features",
    struct_col: str = "attributes",
    more_col: str = "exceededTransferLimit",
    error_col: str = "error",
) -> DataFrame:
    """S2 over landed page files: one row per feature of every series, with
    pages that overlap or were landed twice cut to what is new.

    A series is asked page by page, ordered by ``id_field``, and each page from
    the offset that the kept rows before it have reached (``offset_col``).
    Pages are placed by (series, offset, ``landed_col``).  Rows of a page below
    the largest end so far are dropped; of the rest, a page that starts behind
    that end (a gap), ids that do not rise from page to page, a last page that
    announces more (a cut-off series) and pages behind one that announces no
    more raise :class:`PageError`, as do the page errors of
    :func:`unnest_pages`.

    Pages lie in ranges of that order; the end and the last id before a range
    come from one summary row per range and series, so a series of any length
    spreads over many tasks.  The payload is shuffled once.
    """
    series = F.col(series_col).cast("string") if series_col else F.lit("")
    landed = F.col(landed_col) if landed_col else F.lit(0)
    keyed = pages.withColumns({"__series": series, "__offset": F.col(offset_col).cast("long"), "__landed": landed})
    staged = _staged(keyed, array_col, struct_col, more_col, error_col, "__series", "__offset", "__landed")
    n = F.coalesce(F.size("__attrs"), F.lit(0))
    ident = lambda e: F.get_json_object(e, f"$.{id_field}").cast("long")
    placed = Ranges(
        staged.withColumns({"__n": n, "__end": F.col("__offset") + n, "__last_id": ident(F.try_element_at("__attrs", F.lit(-1)))}),
        [F.col("__series").asc(), F.col("__offset").asc(), F.col("__landed").asc()],
    ).rows
    _check_pages(placed, array_col)
    before = Window.partitionBy("__series").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = placed.groupBy("__series", "__range").agg(F.max("__end").alias("e"), F.max("__last_id").alias("i"), F.min("__more").alias("m"))
    carried = per_range.select(
        "__series", "__range", F.max("e").over(before).alias("__end_before"), F.max("i").over(before).alias("__id_before"), F.min("m").over(before).alias("__more_before")
    )
    inside = Window.partitionBy("__range", "__series").orderBy("__offset", "__landed").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.greatest("__end_before", F.max("__end").over(inside)), F.lit(0))
    joined = placed.join(carried, ["__series", "__range"])
    checked = joined.withColumns({
        "__skip": F.least(F.greatest(end - F.col("__offset"), F.lit(0)), F.col("__n")),
        "__gap": F.col("__offset") > end,
        "__id_so_far": F.greatest("__id_before", F.max("__last_id").over(inside)),
        "__open": F.coalesce(F.least("__more_before", F.min("__more").over(inside)), F.lit(True)),
    })
    new = F.col("__n") > F.col("__skip")
    falls = new & (ident(F.get("__attrs", F.col("__skip").cast("int"))) <= F.col("__id_so_far"))
    where = F.concat_ws(" ", F.lit("at offset"), F.col("__offset").cast("string"), F.when(F.col("__series") != "", F.concat(F.lit("of "), F.col("__series"))))
    problem = (
        F.when(F.col("__gap"), F.concat(F.lit("rows are missing before the page "), where))
        .when(new & ~F.col("__open"), F.concat(F.lit("a page follows the last one "), where))
        .when(falls, F.concat(F.lit("ids do not rise in the page "), where))
    )
    per_series = checked.groupBy("__series").agg(F.min("__more").alias("open"), F.min(problem).alias("problem"))
    text = F.coalesce("problem", F.when(F.col("open"), F.concat(F.lit("the last page announces more rows"), F.when(F.col("__series") != "", F.concat(F.lit(" of "), F.col("__series"))).otherwise(""))))
    found = per_series.agg(F.min(text).alias("t")).first()["t"]
    if found:
        raise PageError(found)
    size = F.col("__n") - F.col("__skip")
    kept = F.when(size > 0, F.slice("__attrs", (F.col("__skip") + 1).cast("int"), F.greatest(size, F.lit(1)).cast("int")))
    rows = checked.select(F.col("__series").alias("series"), F.explode(kept).alias("obj"))
    return _typed(rows, contract, "series")


def strict_value(name: str, kind: DataType) -> Column:
    """A JSON value's text as ``kind``: a number may be written as text or as
    8.0; what cannot be cast fails the query instead of becoming NULL."""
    text = F.col(f"`{name}`")
    value = F.round(text.try_cast("decimal(38,6)")).try_cast(kind) if isinstance(kind, IntegralType) else text.try_cast(kind)
    bad = F.raise_error(F.concat(F.lit(f"{name} cannot be cast to {kind.simpleString()}: "), text))
    return F.when(text.isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce(value, bad))


# ---------------------------------------------------------------- S3
def unnest_items(payloads: DataFrame, request_cols: Sequence[str], loaded_at: str, items_col: str = "items") -> DataFrame:
    """S3: one row per ``items[]`` element; ``article`` comes from the
    request columns, ``viewed_on`` is the yyyyMMdd prefix of the item
    timestamp, ``views`` a strict bigint, ``loaded_at_utc`` one value per
    run.  Other request columns are carried through after these."""
    exploded = payloads.select(*request_cols, F.explode(items_col).alias("it"))
    return exploded.select(
        F.col("it.project").alias("project"),
        F.col("article") if "article" in request_cols else F.col("it.article").alias("article"),
        F.col("it.access").alias("access"),
        F.col("it.agent").alias("agent"),
        F.col("it.granularity").alias("granularity"),
        F.to_date(F.substring(F.col("it.timestamp"), 1, 8), "yyyyMMdd").alias("viewed_on"),
        F.col("it.views").cast("bigint").alias("views"),
        F.to_timestamp(F.lit(loaded_at)).alias("loaded_at_utc"),
        *[c for c in request_cols if c != "article"],
    )


# ---------------------------------------------------------------- S4
def read_whole_text(spark: SparkSession, glob: str, drop_line_pattern: str | None = None) -> DataFrame:
    """One row per file with its full content (``path``, ``content``),
    optionally with every line matching ``drop_line_pattern`` removed."""
    df = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    if drop_line_pattern:
        df = df.withColumn("content", drop_matching_lines(F.col("content"), drop_line_pattern))
    return df


def read_lines(spark: SparkSession, glob: str, drop_line_pattern: str | None = None) -> DataFrame:
    """S4 for files of any size: one row per line, ``(path, block, at, line,
    file_size)``, in the order of (path, block, at).

    Spark cuts large files into byte ranges; a task begins at the first line
    that starts in its range and reads its last line beyond the border, so a
    file is many tasks and no line is cut.  Only ``\\n`` ends a line, so other
    line ends stay in the text.  ``drop_line_pattern`` drops matching lines, as
    :func:`drop_matching_lines` does in whole texts.
    """
    lines = spark.read.option("lineSep", "\n").text(glob).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"), F.col("_metadata.file_size").alias("file_size"),
    )
    return lines.where(~F.col("line").rlike(drop_line_pattern)) if drop_line_pattern else lines


def line_stats(lines: DataFrame) -> DataFrame:
    """Per file of :func:`read_lines` (without a pattern): ``n_lines`` and
    whether it ends with a line end, which the lines alone do not show."""
    size = F.sum(F.octet_length("line") + 1).alias("size")
    found = lines.groupBy("path", "file_size").agg(F.count(F.lit(1)).alias("n_lines"), size)
    return found.select("path", "n_lines", (F.col("size") == F.col("file_size")).alias("ends_with_newline"))


def read_whole_binary(spark: SparkSession, glob: str, encoding: str = "UTF-8") -> DataFrame:
    """S4, binary variant: one row per file (``path``, ``length``,
    ``content`` decoded as text) via the ``binaryFile`` source."""
    df = spark.read.format("binaryFile").load(glob)
    return df.select("path", "length", F.decode("content", encoding).alias("content"))


# S4's line rewrite is the F10 helper
drop_matching_lines = drop_lines


__all__ = [
    "ContractError",
    "PageError",
    "drop_matching_lines",
    "line_stats",
    "project",
    "read_json_table",
    "read_lines",
    "read_whole_binary",
    "read_whole_text",
    "stitch_pages",
    "unnest_items",
    "unnest_pages",
]

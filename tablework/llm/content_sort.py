"""Exact dedup by content sort, in DataFrame operations only.

1. Splitters: a sample of the rows, sorted by content, gives the borders of
   about as many ranges as there are shuffle partitions.
2. One shuffle moves every row to its range; inside a range an external sort
   places equal texts next to each other, and each row's whole text is compared
   with its neighbour's.  A run of equal rows is numbered within its range.
3. The order also holds ``doc_id``, so a text that makes up a third of the
   corpus spreads over many ranges.  A run that goes on over a border is joined
   to the next range's first run by comparing the two border rows; that takes
   one or two rows a range, however many rows there are.

Order: the first ``PREFIX`` characters of the normalised text, its SHA-256, the
whole text, ``doc_id``.  The digest only keeps the splitters short; equality is
decided by comparing texts.

The text is shuffled once; between the steps a table of narrow rows is written
to the shared folder.

Results: one row per input row with ``keep_id`` (the largest ``doc_id`` of the
equal texts), ``group_size``, ``kept`` and ``text_sha256``.  A null text counts
as empty.  Repeated rows with one ``doc_id``: exactly one of them is kept.
Null ids sort first: such a row is kept only where its whole group has none,
and then ``keep_id`` is null.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import ascii_lower, id_and_text, materialise, range_number, range_splitters

PREFIX = 64
SAMPLES_PER_RANGE = 40

_KEY = "struct<p:string,h:string,d:bigint>"


def _runs(docs: DataFrame, ranges: int | None, keep_rows: bool) -> DataFrame:
    """Numbered runs without texts, but for the texts of border rows; with
    ``keep_rows`` also the whole input row of each run's last row.

    ``docs``: doc_id and ``row``, a struct that holds the text.
    """
    text = F.coalesce("row.text", F.lit(""))
    prefix = lambda norm: F.substring(norm, 1, PREFIX)
    key = docs.select("doc_id", "row", ascii_lower(text).alias("norm")).select(
        "doc_id", "row", prefix("norm").alias("p"), F.sha2(F.col("norm").cast("binary"), 256).alias("h")
    )
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_key = F.struct("p", "h", F.col("doc_id").alias("d"))
    borders = range_splitters(key, order_key, ["doc_id", "row.text"], n, docs.count(), SAMPLES_PER_RANGE)
    placed = key.select("doc_id", "row", "h", range_number(borders, _KEY, order_key).alias("rid"))
    moved = placed.repartition("rid").withColumn("norm", ascii_lower(text))
    order = Window.partitionBy("rid").orderBy(prefix("norm"), "h", "norm", F.col("doc_id").asc_nulls_first())
    seen = moved.select(
        "rid", "doc_id", "h", "norm", "row",
        F.row_number().over(order).alias("pos"),
        F.lag("norm").over(order).alias("before"),
        F.lead("norm").over(order).alias("after"),
    )
    border = (F.col("pos") == 1) | F.col("after").isNull()
    flagged = seen.select(
        "rid", "doc_id", "h", "pos",
        F.when(F.col("before").isNull() | (F.col("before") != F.col("norm")), 1).otherwise(0).alias("opens"),
        F.col("after").isNull().alias("last_in_range"),
        (F.col("after").isNull() | (F.col("after") != F.col("norm"))).alias("last_in_run"),
        F.when(border, F.col("norm")).alias("border_text"),
        *([F.when(F.col("after").isNull() | (F.col("after") != F.col("norm")), F.col("row")).alias("row")] if keep_rows else []),
    )
    running = Window.partitionBy("rid").orderBy("pos")
    numbered = flagged.withColumn("run", F.sum("opens").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("rid", "run")
    return materialise(
        numbered.withColumns({"n": F.count(F.lit(1)).over(whole), "top": F.max("doc_id").over(whole)}).drop("opens"), "content-runs"
    )


def _joined_runs(runs: DataFrame) -> DataFrame:
    """(rid, run, n_all, top_all, final): totals of the runs that go on over a
    border.  Two rows per range at most take part."""
    ends = runs.where(F.col("border_text").isNotNull())
    first = ends.where(F.col("pos") == 1).select("rid", F.col("border_text").alias("first_text"), F.col("n").alias("first_n"), F.col("top").alias("first_top"))
    last = ends.where("last_in_range").select("rid", F.col("border_text").alias("last_text"), F.col("run").alias("last_run"), F.col("n").alias("last_n"), F.col("top").alias("last_top"))
    ranges = first.join(last, "rid")
    along = Window.orderBy("rid")
    neighbours = ranges.select("rid", F.lead("rid").over(along).alias("next"))
    goes_on = (
        ranges.select("rid", "last_text").join(neighbours, "rid")
        .join(first.select(F.col("rid").alias("next"), F.col("first_text").alias("next_text")), "next")
        .where(F.col("last_text") == F.col("next_text")).select(F.col("next").alias("rid"), F.lit(True).alias("goes_on"))
    )
    state = ranges.drop("first_text", "last_text").join(goes_on, "rid", "left").select(
        "*",
        F.lag("rid").over(along).alias("prev_rid"),
        F.lag("last_run").over(along).alias("prev_run"),
    )
    head = F.when(F.col("goes_on").isNull(), F.struct(F.col("rid").alias("r"), F.lit(1).cast("bigint").alias("u"))).when(
        F.col("prev_run") > 1, F.struct(F.col("prev_rid").alias("r"), F.col("prev_run").alias("u"))
    )
    chained = state.withColumn("chain", F.last(head, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first_runs = chained.select("rid", F.lit(1).cast("bigint").alias("run"), "chain", F.col("first_n").alias("n"), F.col("first_top").alias("top"))
    last_runs = chained.where(F.col("last_run") > 1).select(
        "rid", F.col("last_run").alias("run"), F.struct(F.col("rid").alias("r"), F.col("last_run").alias("u")).alias("chain"), F.col("last_n").alias("n"), F.col("last_top").alias("top")
    )
    group = Window.partitionBy("chain")
    return first_runs.unionByName(last_runs).select(
        "rid", "run",
        F.sum("n").over(group).alias("n_all"),
        F.max("top").over(group).alias("top_all"),
        (F.max("rid").over(group) == F.col("rid")).alias("final"),
    )


def _verdict(runs: DataFrame) -> DataFrame:
    # at most two rows per range: the bound is the number of ranges
    joined = F.broadcast(_joined_runs(runs))
    return runs.drop("border_text").join(joined, ["rid", "run"], "left").withColumn("kept", F.col("last_in_run") & F.coalesce("final", F.lit(True)))


def dedup_exact(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; see the module's docstring."""
    runs = _runs(id_and_text(docs, id_col, text_col).select("doc_id", F.struct("text").alias("row")), ranges, keep_rows=False)
    return _verdict(runs).select(
        "doc_id",
        F.when(F.col("n_all").isNotNull(), F.col("top_all")).otherwise(F.col("top")).alias("keep_id"),
        F.coalesce("n_all", "n").alias("group_size"),
        "kept",
        F.col("h").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) that :func:`dedup_exact` keeps."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _verdict(_runs(source, ranges, keep_rows=True)).where("kept").select("row.*")

"""End-to-end job queries: the field-recovery load (S1, Q5, P1, F1, K6,
K4, M1) and the incremental pageview load (S3, K5, N1), each run on
whole test tables and compared with SQL over the same tables.

Both jobs write their inputs and outputs under a fresh directory in the
session's checkpoint directory (shared storage on a cluster).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablework import testdata as td
from tablework.contracts import FIELDS, PAGEVIEWS_DAILY, PAGEVIEWS_KEY, RESERVES
from tablework.plans import field_recovery as fr
from tablework.queries import DAILY_SQL, mart_sql, register
from tablework.session import checkpoint_dir
from tablework.sinks.keyed import KeyedTable
from tablework.sinks.store import TableStore
from tablework.streaming.incremental import stream_upsert

JOB_LOADED_AT = "2025-01-01 06:30:00"


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def _to_source_names(df, contract, epoch_ts=(), epoch_date=()):
    cols = []
    for src, _, dst in contract:
        c = F.col(dst)
        if dst in epoch_ts:
            c = F.unix_millis(c)
        elif dst in epoch_date:
            c = F.unix_millis(F.to_timestamp(c))
        cols.append(c.alias(src))
    return df.select(*cols)


@register("field_recovery_load", mart_sql(JOB_LOADED_AT, JOB_LOADED_AT))
def q_field_recovery_load(spark, sf_dir):
    """Land customers and pending orders as source-named JSON lines, run the
    load job (typed JSON scan, contract check, atomic publish with audit
    row) and read the latest-recovery view over the published tables."""
    root = _scratch(spark, "field-load")
    fields = td.fields_from_customer(td.table(spark, sf_dir, "customer"))
    history = td.reserves_from_orders(td.table(spark, sf_dir, "orders"))
    _to_source_names(fields, FIELDS, epoch_ts=("source_updated_at",)).write.option("ignoreNullFields", "false").json(f"{root}/landing/fields")
    _to_source_names(history, RESERVES, epoch_date=("official_estimate_date",)).write.option("ignoreNullFields", "false").json(f"{root}/landing/reserves")
    store = TableStore(spark, f"{root}/store")
    fr.load_field_recovery(spark, store, f"{root}/landing/fields", f"{root}/landing/reserves", "testdata", JOB_LOADED_AT, multiline=False)
    return fr.field_recovery_view(store)


INCREMENTAL_CUTOFF = "2024-01-15 12:00:00"
INCREMENTAL_DAY = "2024-01-15 00:00:00"


def _daily_payloads(events):
    """One payload per (type, user, day) with the day's count as views."""
    daily = events.groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    item = F.struct(
        F.col("event_type").alias("project"),
        F.lit("ignored").alias("article"),
        F.lit("daily").alias("granularity"),
        F.concat(F.date_format("day", "yyyyMMdd"), F.lit("00")).alias("timestamp"),
        F.lit("all-access").alias("access"),
        F.lit("user").alias("agent"),
        F.col("n").cast("bigint").alias("views"),
    )
    return daily.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("article"), F.array(item).alias("items"))


@register(
    "incremental_daily_views",
    DAILY_SQL.replace("max(ts) AS loaded_at_utc", f"TIMESTAMP '{JOB_LOADED_AT}' AS loaded_at_utc"),
)
def q_incremental_daily_views(spark, sf_dir):
    """Two landed drops: counts up to the cut-off, then full days from the
    cut-off day on (correcting that day).  The incremental stream upserts
    both; the final table equals a batch daily count."""
    root = _scratch(spark, "incremental")
    landing = f"{root}/landing"
    table = f"pageviews_daily_{uuid.uuid4().hex}"
    store = KeyedTable(spark, table, f"{root}/pageviews_daily", PAGEVIEWS_DAILY, PAGEVIEWS_KEY, F.date_format("viewed_on", "yyyy-MM"), "month")
    events = td.table(spark, sf_dir, "events")
    _daily_payloads(events.where(F.col("ts") < F.lit(INCREMENTAL_CUTOFF).cast("timestamp_ntz"))).write.mode("append").json(landing)
    stream_upsert(spark, landing, store, table, PAGEVIEWS_KEY, checkpoint=f"{root}/stream", loaded_at=JOB_LOADED_AT)
    _daily_payloads(events.where(F.col("ts") >= F.lit(INCREMENTAL_DAY).cast("timestamp_ntz"))).write.mode("append").json(landing)
    stream_upsert(spark, landing, store, table, PAGEVIEWS_KEY, checkpoint=f"{root}/stream", loaded_at=JOB_LOADED_AT)
    return store.read()


# ====================================================================
# S2 landed API pages built from customers, unnested again
# ====================================================================
PAGE_SIZE = 1000  # fixed value: features per API page

CUSTOMER_PAGE_CONTRACT = [
    ("OBJECTID", "bigint", "object_id"),
    ("fldName", "string", "name"),
    ("fldNation", "int", "nation"),
    ("fldBalance", "double", "balance"),
    ("fldSegment", "string", "segment"),
]


@register(
    "customer_pages",
    """
SELECT c_custkey AS OBJECTID, c_name AS fldName, c_nationkey AS fldNation,
       c_acctbal AS fldBalance, c_mktsegment AS fldSegment
FROM customer
""",
)
def q_customer_pages(spark, sf_dir):
    """Customers as paged API payloads (at most PAGE_SIZE features per page,
    pages before the last flagged as exceeding the transfer limit), then
    S2 unnests them back into typed rows."""
    from tablework.sources.json_scan import unnest_pages

    c = td.table(spark, sf_dir, "customer")
    attrs = F.struct(
        F.col("c_custkey").alias("OBJECTID"),
        F.col("c_name").alias("fldName"),
        F.col("c_nationkey").alias("fldNation"),
        F.col("c_acctbal").alias("fldBalance"),
        F.col("c_mktsegment").alias("fldSegment"),
    )
    pages = c.groupBy(F.floor(F.col("c_custkey") / PAGE_SIZE).alias("page_no")).agg(
        F.collect_list(F.struct(attrs.alias("attributes"))).alias("features"),
        F.count(F.lit(1)).alias("n"),
    )
    pages = pages.select("features", (F.col("n") == PAGE_SIZE).alias("exceededTransferLimit"))
    return unnest_pages(pages, CUSTOMER_PAGE_CONTRACT)


# ====================================================================
# S2 landed page files that overlap, stitched
# ====================================================================
LANDED_PAGE, LANDED_OVERLAP = 100, 10


@register(
    "customer_page_files",
    """
SELECT c_mktsegment AS series, c_custkey AS OBJECTID, c_name AS fldName, c_nationkey AS fldNation,
       c_acctbal AS fldBalance, c_mktsegment AS fldSegment
FROM customer
""",
)
def q_customer_page_files(spark, sf_dir):
    """Every segment's customers land as a series of page files; each page but
    the first begins with the last rows of the page before.  Stitching drops
    those and finds no gap."""
    from tablework.operators.ranges import Ranges
    from tablework.sources.json_scan import stitch_pages

    c = td.table(spark, sf_dir, "customer")
    ranked = Ranges(c, [F.col("c_mktsegment").asc(), F.col("c_custkey").asc()]).numbered("at")
    series = ranked.groupBy("c_mktsegment").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = ranked.join(series, "c_mktsegment").withColumn("at", F.col("at") - F.col("first"))
    own = F.floor(F.col("at") / LANDED_PAGE)
    again = F.when((F.col("at") >= (own + 1) * LANDED_PAGE - LANDED_OVERLAP) & ((own + 1) * LANDED_PAGE < F.col("n")), own + 1)
    attrs = F.struct(
        F.col("c_custkey").alias("OBJECTID"), F.col("c_name").alias("fldName"), F.col("c_nationkey").alias("fldNation"),
        F.col("c_acctbal").alias("fldBalance"), F.col("c_mktsegment").alias("fldSegment"),
    )
    dealt = placed.withColumn("page", F.explode(F.filter(F.array(own, again), lambda p: p.isNotNull())))
    rows = dealt.groupBy("c_mktsegment", "page", "n").agg(F.array_sort(F.collect_list(F.struct("at", attrs.alias("attributes")))).alias("rows"))
    pages = rows.select(
        F.col("c_mktsegment").alias("layer"),
        F.greatest(F.col("page") * LANDED_PAGE - F.when(F.col("page") > 0, LANDED_OVERLAP).otherwise(0), F.lit(0)).alias("resultOffset"),
        F.transform("rows", lambda r: F.struct(r["attributes"].alias("attributes"))).alias("features"),
        ((F.col("page") + 1) * LANDED_PAGE < F.col("n")).alias("exceededTransferLimit"),
    )
    landing = f"{_scratch(spark, 'pages')}/landing"
    pages.write.json(landing)
    landed = spark.read.schema("layer string, resultOffset long, features string, exceededTransferLimit boolean").json(landing)
    return stitch_pages(landed, CUSTOMER_PAGE_CONTRACT, "OBJECTID", series_col="layer")


# ====================================================================
# S4 documents written as files and read back line by line
# ====================================================================
@register(
    "document_files",
    """
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), n AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l
)
SELECT row_number() OVER (ORDER BY doc_id, i) AS line_no, line FROM n WHERE NOT regexp_matches(line, '[Ll][Ii][Cc][Ee][Nn][Ss][Ee]')
""",
)
def q_document_files(spark, sf_dir):
    """All texts in the order of their ids, written as a few files, read back
    without the lines that hold a licence, and numbered."""
    from tablework.operators.ranges import Ranges
    from tablework.sources.json_scan import read_lines

    folder = f"{_scratch(spark, 'texts')}/files"
    docs = td.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").write.option("lineSep", "\n").text(folder)
    lines = read_lines(spark, folder, "[Ll][Ii][Cc][Ee][Nn][Ss][Ee]")
    placed = Ranges(lines.select("path", "block", "at", "line"), [F.col("path").asc(), F.col("block").asc(), F.col("at").asc()])
    return placed.numbered("line_no").select("line_no", "line")

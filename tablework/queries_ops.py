"""Registered operator queries (windows, sources, sinks, sets, quality,
reconciliation, lineage and scalar functions) over the test tables.

Each query reads whole tables; membership of "desired", "incoming" and
similar sets is derived from data values (status, balance, dates), never
from id subsets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework import testdata as td
from tablework.functions import columns as fx
from tablework.operators import aggregates as agg
from tablework.operators import filters as flt
from tablework.operators import joins as jn
from tablework.operators import quality as q
from tablework.operators import shape
from tablework.operators import windows as win
from tablework.plans import changes as ch
from tablework.queries import HISTORY_SQL, FIELDS_SQL, register
from tablework.sinks import store as st
from tablework.sinks.keyed import upsert_join
from tablework.sources import catalog as cat
from tablework.sources import json_scan as js


def _t(spark, sf_dir, name):
    return td.table(spark, sf_dir, name)


# ====================================================================
# W1 / W2
# ====================================================================
@register(
    "latest_order_per_customer",
    """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1
""",
)
def q_latest_order_per_customer(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return win.latest_per_key(o, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()])


RUN_STATUS_SQL = """CASE event_type WHEN 'purchase' THEN 'RUN_STATUS_SUCCEEDED'
  WHEN 'error' THEN 'RUN_STATUS_FAILED'
  ELSE 'RUN_STATUS_' || upper(event_type) END"""


@register(
    "latest_run_per_user",
    f"""
WITH runs AS (SELECT user_id, event_id AS run_number, {RUN_STATUS_SQL} AS status FROM events),
latest AS (
  SELECT user_id, CAST(run_number AS VARCHAR) || '|' || status AS tag FROM runs
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run_number DESC NULLS LAST) = 1
)
SELECT user_id,
  CAST(split_part(tag, '|', 1) AS BIGINT) AS run_number,
  substr(tag, strpos(tag, '|') + 1) AS status,
  CASE WHEN substr(tag, strpos(tag, '|') + 1) = 'RUN_STATUS_SUCCEEDED' THEN 'succeeded'
       WHEN substr(tag, strpos(tag, '|') + 1) IN ('RUN_STATUS_FAILED', 'RUN_STATUS_CANCELLED') THEN 'failed'
       ELSE 'running' END AS outcome
FROM latest
""",
)
def q_latest_run_per_user(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    et = F.col("event_type")
    status = F.when(et == "purchase", "RUN_STATUS_SUCCEEDED").when(et == "error", "RUN_STATUS_FAILED").otherwise(F.concat(F.lit("RUN_STATUS_"), F.upper(et)))
    runs = e.select("user_id", F.col("event_id").alias("run_number"), status.alias("status"))
    return win.latest_run(runs, "user_id", "run_number", "status")


# ====================================================================
# S3 item payloads, F13 JSON fields
# ====================================================================
ITEMS_LOADED_AT = "2024-02-01 06:17:00"


def event_payloads(spark, sf_dir):
    """One payload per event, its single item built from the event."""
    e = _t(spark, sf_dir, "events")
    item = F.struct(
        F.col("event_type").alias("project"),
        F.lit("ignored").alias("article"),
        F.lit("hourly").alias("granularity"),
        F.date_format("ts", "yyyyMMddHH").alias("timestamp"),
        F.lit("all-access").alias("access"),
        F.lit("user").alias("agent"),
        fx.json_field("props", "$.k").alias("views"),
    )
    return e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("article"), F.array(item).alias("items"))


@register(
    "pageview_items",
    f"""
SELECT event_type AS project,
  'user_' || CAST(user_id AS VARCHAR) AS article,
  'all-access' AS access, 'user' AS agent, 'hourly' AS granularity,
  strptime(substr(strftime(ts, '%Y%m%d%H'), 1, 8), '%Y%m%d')::DATE AS viewed_on,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS views,
  TIMESTAMP '{ITEMS_LOADED_AT}' AS loaded_at_utc
FROM events
""",
)
def q_pageview_items(spark, sf_dir):
    return js.unnest_items(event_payloads(spark, sf_dir), ["article"], ITEMS_LOADED_AT)


# ====================================================================
# K5 / J4 / X2 keyed upsert on orders
# ====================================================================
CORRECTIONS_SQL = """
SELECT l_orderkey AS o_orderkey,
  CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))
                 * (1 + CAST(l_tax AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS o_totalprice
FROM lineitem
GROUP BY l_orderkey
"""


def _corrections(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    # Money in exact decimals: a double sum depends on summation order and
    # can flip a value that sits on a half-cent boundary.
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    return li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum(price * (1 - disc) * (1 + tax)), 2).cast("double").alias("o_totalprice")
    )


@register(
    "orders_upsert",
    f"""
WITH incoming AS ({CORRECTIONS_SQL}),
target AS (SELECT o_orderkey, o_totalprice FROM orders)
SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.o_orderkey = t.o_orderkey)
UNION ALL
SELECT o_orderkey, o_totalprice FROM incoming
""",
)
def q_orders_upsert(spark, sf_dir):
    target = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return upsert_join(target, _corrections(spark, sf_dir), ["o_orderkey"])


@register(
    "orders_deleted_by_upsert",
    f"""
WITH incoming AS ({CORRECTIONS_SQL})
SELECT o_orderkey, o_custkey, o_totalprice FROM orders t
WHERE EXISTS (SELECT 1 FROM incoming i WHERE i.o_orderkey = t.o_orderkey)
""",
)
def q_orders_deleted(spark, sf_dir):
    target = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    _, deleted = st.delete_matching(target, _corrections(spark, sf_dir), ["o_orderkey"])
    return deleted


# ====================================================================
# A4 load statistics (the audit row of a load)
# ====================================================================
@register(
    "load_stats",
    f"""
WITH fields AS ({FIELDS_SQL}), history AS ({HISTORY_SQL})
SELECT (SELECT CAST(count(*) AS BIGINT) FROM fields) AS field_rows,
       CAST(count(*) AS BIGINT) AS reserve_history_rows,
       max(reserve_version) AS latest_reserve_version
FROM history
""",
)
def q_load_stats(spark, sf_dir):
    fields = td.fields_from_customer(_t(spark, sf_dir, "customer"))
    history = td.reserves_from_orders(_t(spark, sf_dir, "orders"))
    return agg.load_stats(fields, history)


# ====================================================================
# X1 membership reconcile, X3 distinct union
# ====================================================================
@register(
    "membership_reconcile",
    """
WITH desired AS (SELECT DISTINCT c_nationkey AS role, c_custkey AS member FROM customer WHERE c_acctbal >= 0),
current AS (SELECT DISTINCT c_nationkey AS role, c_custkey AS member FROM customer WHERE c_acctbal < 5000)
SELECT role, member, 'GRANT' AS action FROM (SELECT * FROM desired EXCEPT SELECT * FROM current)
UNION ALL
SELECT role, member, 'REVOKE' AS action FROM (SELECT * FROM current EXCEPT SELECT * FROM desired)
""",
)
def q_membership_reconcile(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    # every customer is on one side or on both
    desired = c.where(F.col("c_acctbal") >= 0).select(F.col("c_nationkey").alias("role"), F.col("c_custkey").alias("member"))
    current = c.where(F.col("c_acctbal") < 5000).select(F.col("c_nationkey").alias("role"), F.col("c_custkey").alias("member"))
    return shape.reconcile_members(desired, current, ["role", "member"], "authoritative")


@register(
    "distinct_union",
    """
SELECT s_nationkey AS nationkey FROM supplier
UNION
SELECT c_nationkey AS nationkey FROM customer
ORDER BY nationkey
""",
)
def q_distinct_union(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return shape.distinct_union([s, c]).orderBy("nationkey")


# ====================================================================
# A7 / Q2 duplicates
# ====================================================================
@register(
    "duplicate_documents",
    """
SELECT sha256(text) AS text_sha256, CAST(count(*) AS BIGINT) AS n_copies, min(doc_id) AS first_doc_id
FROM documents
GROUP BY text
HAVING count(*) > 1
""",
)
def q_duplicate_documents(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    # by digest: the exchange moves 64 characters a row instead of the text
    dup = agg.duplicates(d.select(F.sha2("text", 256).alias("text_sha256"), "doc_id"), ["text_sha256"], extra=[F.min("doc_id").alias("first_doc_id")])
    return dup.select("text_sha256", F.col("n_copies").cast("bigint").alias("n_copies"), "first_doc_id")


@register(
    "duplicate_part_names",
    """
SELECT p_type, p_name, CAST(count(*) AS BIGINT) AS n_rows
FROM part GROUP BY p_type, p_name HAVING count(*) > 1
""",
)
def q_duplicate_part_names(spark, sf_dir):
    return q.check_unique(_t(spark, sf_dir, "part"), ["p_type", "p_name"]).withColumn("n_rows", F.col("n_rows").cast("bigint"))


# ====================================================================
# J6 cardinality-checked lookup
# ====================================================================
@register(
    "lookup_one",
    """
WITH wanted AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size <= 25),
live AS (SELECT p_name AS name, p_partkey AS id FROM part WHERE p_size > 25),
counts AS (SELECT name, count(*) AS n, min(id) AS id FROM live GROUP BY name)
SELECT w.name, CAST(coalesce(c.n, 0) AS BIGINT) AS n_live, c.id AS live_id,
  CASE WHEN c.n IS NULL THEN 'none' WHEN c.n = 1 THEN 'found' ELSE 'ambiguous' END AS resolution
FROM wanted w LEFT JOIN counts c USING (name)
""",
)
def q_lookup_one(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    wanted = p.where(F.col("p_size") <= 25).select(F.col("p_name").alias("name")).distinct()
    live = p.where(F.col("p_size") > 25).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    out = ch.lookup_one(wanted, live, ["name"], "id").drop("live_status")
    return out.select(
        "name",
        F.col("n_live").cast("bigint").alias("n_live"),
        F.col("live_id").cast("bigint").alias("live_id"),
        F.when(F.col("n_live") == 0, "none").when(F.col("n_live") == 1, "found").otherwise("ambiguous").alias("resolution"),
    )


@register(
    "ambiguous_ids",
    f"""
WITH live AS (SELECT l_returnflag AS name, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id FROM lineitem),
wanted AS (SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT DISTINCT l_returnflag FROM lineitem WHERE l_quantity > 10),
several AS (SELECT name, count(*) AS n_live FROM live WHERE name IN (SELECT name FROM wanted) GROUP BY name HAVING count(*) > 1),
placed AS (
  SELECT l.name, l.id, s.n_live, (row_number() OVER (ORDER BY l.name, l.id) - 1) // {ch.ID_CHUNK} AS chunk FROM live l JOIN several s USING (name)
),
texts AS (SELECT name, n_live, chunk, string_agg(id, ',' ORDER BY id) AS ids FROM placed GROUP BY ALL)
SELECT name, CAST(chunk - min(chunk) OVER (PARTITION BY name) AS BIGINT) AS seq,
  CASE WHEN chunk = min(chunk) OVER (PARTITION BY name) THEN n_live END AS n_live, ids
FROM texts
""",
)
def q_ambiguous_ids(spark, sf_dir):
    """Every id of the names that are live several times (a return flag holds
    a quarter of all line items at least), in chunks."""
    li = _t(spark, sf_dir, "lineitem")
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    live = li.select(F.col("l_returnflag").alias("name"), line.alias("id"))
    wanted = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).unionByName(li.where(F.col("l_quantity") > 10).select(F.col("l_returnflag").alias("name")))
    return ch.ambiguous_ids(wanted, live, ["name"])


# ====================================================================
# Q1 / Q4 row rules, Q3 references, Q7 separation
# ====================================================================
SEGMENTS_ALLOWED = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")


@register(
    "customer_violations",
    f"""
SELECT c_custkey, rule, path, message FROM (
  SELECT c_custkey, 'required' AS rule, 'c_name' AS path, 'c_name is required' AS message FROM customer WHERE c_name IS NULL OR c_name = ''
  UNION ALL
  SELECT c_custkey, 'pattern', 'c_name', 'c_name must match Customer#0000000[0-4][0-9]+' FROM customer
    WHERE c_name IS NOT NULL AND NOT regexp_matches(c_name, 'Customer#0000000[0-4][0-9]+')
  UNION ALL
  SELECT c_custkey, 'enum', 'c_mktsegment', 'c_mktsegment must be one of {", ".join(SEGMENTS_ALLOWED)}' FROM customer
    WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ({", ".join(repr(s) for s in SEGMENTS_ALLOWED)})
  UNION ALL
  SELECT c_custkey, 'min_length', 'c_mktsegment', 'c_mktsegment must have at least 9 characters' FROM customer
    WHERE c_mktsegment IS NOT NULL AND length(c_mktsegment) < 9
  UNION ALL
  SELECT c_custkey, 'type', 'c_acctbal', 'c_acctbal must be of type integer' FROM customer
    WHERE c_acctbal IS NOT NULL AND NOT regexp_full_match(CAST(c_acctbal AS VARCHAR), '-?[0-9]+(\\.0+)?')
)
""",
)
def q_customer_violations(spark, sf_dir):
    rules = [
        q.Rule("required", "c_name"),
        q.Rule("pattern", "c_name", "Customer#0000000[0-4][0-9]+"),
        q.Rule("enum", "c_mktsegment", SEGMENTS_ALLOWED),
        q.Rule("min_length", "c_mktsegment", 9),
        q.Rule("type", "c_acctbal", "integer"),
    ]
    return q.check_rows(_t(spark, sf_dir, "customer"), rules, ["c_custkey"])


@register(
    "part_selector_violations",
    """
WITH p AS (
  SELECT p_partkey,
    CASE WHEN p_size < 20 THEN p_brand END AS share,
    CASE WHEN p_size >= 15 AND p_size < 40 THEN p_type END AS url,
    CASE WHEN p_size >= 35 THEN p_name END AS input,
    CASE WHEN p_retailprice > 1500 THEN p_name END AS "column",
    CASE WHEN p_retailprice > 1800 THEN p_type END AS "table"
  FROM part
)
SELECT p_partkey, rule, path, message FROM (
  SELECT p_partkey, 'exactly_one' AS rule, 'share' AS path, 'exactly one of share, url, input is required' AS message FROM p
    WHERE (CAST(share IS NOT NULL AND share <> '' AS INTEGER) + CAST(url IS NOT NULL AND url <> '' AS INTEGER)
         + CAST(input IS NOT NULL AND input <> '' AS INTEGER)) <> 1
  UNION ALL
  SELECT p_partkey, 'requires', 'column', 'column requires table' FROM p
    WHERE ("column" IS NOT NULL AND "column" <> '') AND NOT ("table" IS NOT NULL AND "table" <> '')
)
""",
)
def q_part_selector_violations(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") < 20, F.col("p_brand")).alias("share"),
        F.when((F.col("p_size") >= 15) & (F.col("p_size") < 40), F.col("p_type")).alias("url"),
        F.when(F.col("p_size") >= 35, F.col("p_name")).alias("input"),
        F.when(F.col("p_retailprice") > 1500, F.col("p_name")).alias("column"),
        F.when(F.col("p_retailprice") > 1800, F.col("p_type")).alias("table"),
    )
    rules = [q.Rule("exactly_one", "share", ["share", "url", "input"]), q.Rule("requires", "column", ["table"])]
    return q.check_rows(p, rules, ["p_partkey"])


@register(
    "missing_references",
    """
WITH existing AS (
  SELECT n_nationkey AS nationkey FROM nation WHERE n_regionkey <> 4
  UNION
  SELECT c_nationkey FROM customer WHERE c_acctbal < -900
)
SELECT s_suppkey, s_nationkey FROM supplier s
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.nationkey = s.s_nationkey)
""",
)
def q_missing_references(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").where(F.col("n_regionkey") != 4).select(F.col("n_nationkey").alias("nationkey"))
    planned = _t(spark, sf_dir, "customer").where(F.col("c_acctbal") < -900).select(F.col("c_nationkey").alias("nationkey"))
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return q.check_references(supplier, nation, ["s_nationkey"], ["nationkey"], planned=planned)


@register(
    "separation_check",
    """
WITH preview AS (
  SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey > 2 THEN 'db_' || CAST(c_nationkey AS VARCHAR) END AS database FROM customer
),
prod AS (
  SELECT c_custkey,
    CASE WHEN c_acctbal < 0 THEN c_name ELSE c_name || '_prod' END AS name,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN 'db_prod' WHEN c_nationkey > 2 THEN 'db_' || CAST(c_nationkey AS VARCHAR) END AS database
  FROM customer
)
SELECT a.c_custkey, 'name' AS "column", a.name AS shared_value FROM preview a JOIN prod b USING (c_custkey) WHERE a.name IS NOT DISTINCT FROM b.name
UNION ALL
SELECT a.c_custkey, 'database', a.database FROM preview a JOIN prod b USING (c_custkey) WHERE a.database IS NOT DISTINCT FROM b.database
""",
)
def q_separation_check(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    database = F.when(F.col("c_nationkey") > 2, F.concat(F.lit("db_"), F.col("c_nationkey").cast("string")))  # absent for some
    preview = c.select("c_custkey", F.col("c_name").alias("name"), database.alias("database"))
    prod = c.select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("_prod"))).alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", database).otherwise(F.lit("db_prod")).alias("database"),
    )
    return q.check_separation(preview, prod, ["c_custkey"], ["name", "database"])


# ====================================================================
# K7 snapshot include filter, P10 scope guard, P5 blank equality
# ====================================================================
SNAPSHOT_INCLUDE = ["nation_1.*", "nation_2*.supplier#0000000?7", "nation_9.supplier#000000017"]


@register(
    "snapshot_selection",
    """
WITH inventory AS (
  SELECT lower(n.n_name) AS table_schema, lower(s.s_name) AS table_name
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
)
SELECT table_schema, table_name FROM inventory
WHERE (table_schema || '.' || table_name) LIKE 'nation\\_1.%' ESCAPE '\\'
   OR regexp_full_match(table_schema || '.' || table_name, 'nation_2.*\\.supplier#0000000.7')
   OR (table_schema || '.' || table_name) = 'nation_9.supplier#000000017'
""",
)
def q_snapshot_selection(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    n = _t(spark, sf_dir, "nation")
    inv = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.lower("n_name").alias("table_schema"), F.lower("s_name").alias("table_name"))
    return st.filter_inventory(inv, SNAPSHOT_INCLUDE)


@register(
    "scope_guard",
    """
WITH cand AS (
  SELECT c_custkey,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN 'share' ELSE 'dive' END AS type,
    CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN c_name || '__feature_x' ELSE c_name END AS name
  FROM customer
),
prod AS (
  SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN c_name || '__feature_x' ELSE c_name || '_prod' END AS production_name
  FROM customer
)
SELECT cand.c_custkey, cand.type, cand.name,
  CASE WHEN p.production_name IS NOT NULL AND cand.name = p.production_name
         THEN 'refusing to delete preview ' || cand.type || ' because it matches production: ' || cand.name
       WHEN NOT (contains(cand.name, '__feature_x') OR contains(cand.name, 'preview'))
         THEN 'refusing to ' || CASE WHEN cand.type IN ('share', 'database') THEN 'drop' ELSE 'delete' END
              || ' preview ' || cand.type || ' without branch slug __feature_x'
  END AS guard_error
FROM cand LEFT JOIN prod p USING (c_custkey)
""",
)
def q_scope_guard(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    cand = c.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "FURNITURE", "share").otherwise("dive").alias("type"),
        F.when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), F.concat("c_name", F.lit("__feature_x"))).otherwise(F.col("c_name")).alias("name"),
    )
    production = c.select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 9000, F.concat("c_name", F.lit("__feature_x"))).otherwise(F.concat("c_name", F.lit("_prod"))).alias("production_name"),
    )
    return flt.scope_guard(cand, "name", ["__feature_x", "", "preview"], production, ["c_custkey"])


@register(
    "blank_equality",
    """
SELECT doc_id,
  (coalesce(nullif(source, 'src3'), '') = '') AS blank_source,
  (lang = 'en') AS is_en
FROM documents
""",
)
def q_blank_equality(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    src = F.when(F.col("source") != "src3", F.col("source"))
    return d.select("doc_id", fx.blank_eq(src, "").alias("blank_source"), fx.blank_eq("lang", "en").alias("is_en"))


# ====================================================================
# T3 bounded listing (the limit is the feature: one listing page)
# ====================================================================
LISTING_SIZE = 1000  # fixed value: rows per listing call


@register(
    "customer_listing",
    f"""
SELECT c_custkey, c_name FROM customer
ORDER BY c_name, c_custkey
LIMIT {LISTING_SIZE} OFFSET 0
""",
)
def q_customer_listing(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return shape.page(c, [F.col("c_name").asc_nulls_last(), F.col("c_custkey").asc()], LISTING_SIZE, 0)


@register(
    "order_listing_deep",
    f"""
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC NULLS LAST, o_totalprice NULLS LAST, o_orderkey
LIMIT {LISTING_SIZE} OFFSET (SELECT count(*) // 2 FROM orders)
""",
)
def q_order_listing_deep(spark, sf_dir):
    """T3 deep inside the order: the page in the middle of all orders."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    order = [F.col("o_orderdate").desc_nulls_last(), F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey").asc()]
    return shape.page(o, order, LISTING_SIZE, o.count() // 2)


# ====================================================================
# J3 multi-key left join, A5 count per group, S8/S10 named tables and
# parameterised SQL, X1 additive
# ====================================================================
@register(
    "segment_debtors",
    """
SELECT c_nationkey, c_mktsegment, count(*) AS customers,
  nullif(count(*) FILTER (WHERE c_acctbal < 0), 0) AS debtors
FROM customer GROUP BY ALL
""",
)
def q_segment_debtors(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    keys = ["c_nationkey", "c_mktsegment"]
    all_rows = agg.count_per_group(c, keys, "c_custkey", "customers")
    debtors = agg.count_per_group(c.where(F.col("c_acctbal") < 0), keys, "c_custkey", "debtors")
    return jn.multi_key_left(all_rows, debtors, keys)


@register(
    "orders_since",
    """
SELECT o_orderstatus, count(*) AS n_orders, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS recent
FROM orders GROUP BY o_orderstatus
""",
)
def q_orders_since(spark, sf_dir):
    cat.register_tables(spark, sf_dir, ["orders"])
    return cat.run_sql(
        spark,
        "SELECT o_orderstatus, count(*) AS n_orders, count_if(o_orderdate >= CAST(:since AS TIMESTAMP_NTZ)) AS recent FROM orders GROUP BY o_orderstatus",
        {"since": "1997-01-01"},
    )


@register(
    "membership_additive",
    """
SELECT DISTINCT c_nationkey AS role, c_custkey AS member, 'GRANT' AS action FROM customer WHERE c_acctbal >= 5000
""",
)
def q_membership_additive(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("role"), F.col("c_custkey").alias("member"), "c_acctbal")
    desired = c.where(F.col("c_acctbal") >= 0).drop("c_acctbal")
    current = c.where(F.col("c_acctbal") < 5000).drop("c_acctbal")
    return shape.reconcile_members(desired, current, ["role", "member"], "additive")

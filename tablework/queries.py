"""Registry of the queries checked by the driver.

Every entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with
an equivalent DuckDB SQL string over the same parquet tables (or ``None``
where SQL cannot express the operator).  Computed columns carry the same
alias on both sides.  Aggregated doubles are rounded on both sides to a
number of digits where the two engines cannot disagree (sums of values
with at most five decimals, rounded to six).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework import testdata as td
from tablework.contracts import RESERVES
from tablework.plans import field_recovery as fr
from tablework.plans import pageviews as pv
from tablework.plans import starter as st

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return td.table(spark, sf_dir, name)


# ====================================================================
# SQL twins of the adapters
# ====================================================================
def fields_sql(loaded_at: str) -> str:
    return FIELDS_SQL_T.replace("{LOADED}", loaded_at)


def history_sql(loaded_at: str) -> str:
    return HISTORY_SQL_T.replace("{LOADED}", loaded_at)


FIELDS_SQL_T = """
SELECT
  c_custkey AS object_id,
  c_custkey AS field_id,
  c_name AS field_name,
  CASE WHEN c_acctbal < 0 THEN 'Shut down'
       WHEN c_acctbal < 5000 THEN 'Producing'
       ELSE 'Approved for production' END AS activity_status,
  CAST(1970 + c_nationkey AS INTEGER) AS discovery_year,
  'Operator ' || CAST(c_nationkey AS VARCHAR) AS operator_name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'OIL' WHEN 'BUILDING' THEN 'OIL/GAS'
       WHEN 'FURNITURE' THEN 'GAS' WHEN 'HOUSEHOLD' THEN 'GAS/CONDENSATE'
       WHEN 'MACHINERY' THEN 'OIL/CONDENSATE' END AS hydrocarbon_type,
  CASE WHEN c_nationkey < 10 THEN 'North sea'
       WHEN c_nationkey < 18 THEN 'Norwegian sea'
       ELSE 'Barents sea' END AS main_area,
  'https://example.org/field/' || CAST(c_custkey AS VARCHAR) AS fact_page_url,
  epoch_ms(1735689600000 + c_custkey * 60000) AS source_updated_at,
  TIMESTAMP '{LOADED}' AS loaded_at_utc
FROM customer
"""

HISTORY_SQL_T = """
SELECT
  o_orderkey AS object_id,
  o_custkey AS field_id,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE year(o_orderdate) END AS INTEGER) AS reserve_version,
  CAST(o_orderdate AS DATE) AS official_estimate_date,
  o_totalprice / 1000 AS recoverable_oil_mill_sm3,
  o_totalprice / 2000 AS recoverable_gas_bill_sm3,
  CAST(NULL AS DOUBLE) AS recoverable_ngl_mill_tonnes,
  CAST(NULL AS DOUBLE) AS recoverable_condensate_mill_sm3,
  o_totalprice / 1000 * 1.5 AS recoverable_oe_mill_sm3,
  (o_totalprice * 2 - 300000) / 1000 AS remaining_oil_mill_sm3,
  o_totalprice / 4000 AS remaining_gas_bill_sm3,
  CAST(NULL AS DOUBLE) AS remaining_ngl_mill_tonnes,
  CAST(NULL AS DOUBLE) AS remaining_condensate_mill_sm3,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE (o_totalprice - 100000) / 1000 END AS remaining_oe_mill_sm3,
  o_totalprice / 1000 + dayofmonth(o_orderdate) AS inplace_oil_mill_sm3,
  CAST(NULL AS DOUBLE) AS inplace_associated_liquid_mill_sm3,
  CAST(NULL AS DOUBLE) AS inplace_associated_gas_bill_sm3,
  CAST(NULL AS DOUBLE) AS inplace_free_gas_bill_sm3,
  TIMESTAMP '{LOADED}' AS loaded_at_utc
FROM orders
"""
FIELDS_SQL = fields_sql(td.FIELDS_LOADED_AT)
HISTORY_SQL = history_sql(td.RESERVES_LOADED_AT)

def _floor_zero(x: str) -> str:
    """x below zero becomes 0 (exact in binary floating point)."""
    return f"((abs({x}) + ({x})) / 2)"


def _or_zero(column: str) -> str:
    return f"ifnull(est.{column}, 0)"


_MEASURES = [target for _, _, target in RESERVES if target not in ("object_id", "field_id")]
_PRODUCED = f"100.0 * (est.recoverable_oil_mill_sm3 - {_or_zero('remaining_oil_mill_sm3')}) / nullif({_floor_zero('est.recoverable_oil_mill_sm3')}, 0)"
_DERIVED = {
    # list look-up and a NULL divisor instead of conditions
    "oil_recovery_factor_pct": f"[NULL, 100.0 * est.recoverable_oil_mill_sm3 / nullif({_floor_zero('est.inplace_oil_mill_sm3')}, 0)]"
    "[1 + CAST(ifnull(list_contains(['OIL', 'OIL/GAS', 'OIL/CONDENSATE'], land.hydrocarbon_type), false) AS INTEGER)]",
    "recovered_oil_mill_sm3": _floor_zero(f"{_or_zero('recoverable_oil_mill_sm3')} - {_or_zero('remaining_oil_mill_sm3')}"),
    # the middle one of 0, x and 100
    "produced_share_of_recoverable_oil_pct": f"list_sort([0.0, {_PRODUCED}, 100.0], 'ASC', 'NULLS FIRST')[2 - CAST(({_PRODUCED}) IS NULL AS INTEGER)]",
    "recovered_oe_mill_sm3": _floor_zero(f"{_or_zero('recoverable_oe_mill_sm3')} - {_or_zero('remaining_oe_mill_sm3')}"),
    "remaining_oe_mill_sm3_nonnegative": _floor_zero(_or_zero("remaining_oe_mill_sm3")),
    "loaded_at_utc": "list_max([land.loaded_at_utc, est.loaded_at_utc])",
}
# The newest estimate of a field is the row of its largest key, as one struct;
# absent parts of a key are below all others.
MART_SQL_T = f"""
SELECT land.* EXCLUDE (object_id, loaded_at_utc), {", ".join(f"est.{m} AS {m}" for m in _MEASURES)},
  {", ".join(f"{sql} AS {name}" for name, sql in _DERIVED.items())}
FROM ({{FIELDS}}) AS land
LEFT JOIN (
  SELECT entry.field_id AS owner,
    arg_max(entry, {{{{'v': ifnull(entry.reserve_version, -1), 'd': ifnull(entry.official_estimate_date, DATE '0001-01-01'), 'o': entry.object_id}}}}) AS est
  FROM ({{HISTORY}}) AS entry
  GROUP BY entry.field_id
) AS newest ON newest.owner = land.field_id
""".replace("{{'v'", "{'v'").replace("entry.object_id}}", "entry.object_id}")


def mart_sql(fields_loaded: str, reserves_loaded: str) -> str:
    return MART_SQL_T.replace("{FIELDS}", fields_sql(fields_loaded)).replace("{HISTORY}", history_sql(reserves_loaded))


MART_SQL = mart_sql(td.FIELDS_LOADED_AT, td.RESERVES_LOADED_AT)


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = td.fields_from_customer(_t(spark, sf_dir, "customer"))
    history = td.reserves_from_orders(_t(spark, sf_dir, "orders"))
    return fr.field_recovery_latest(fields, history)


# ====================================================================
# Field-recovery marts (M1-M4)
# ====================================================================
@register("field_recovery_latest", MART_SQL)
def q_field_recovery_latest(spark, sf_dir):
    return mart(spark, sf_dir)


@register(
    "recovery_summary",
    f"""
WITH shown AS (SELECT * FROM ({MART_SQL}) WHERE main_area = 'North sea'),
-- the median from the sorted list of all values
factors AS (SELECT list_sort(list_filter(list(oil_recovery_factor_pct), lambda x: x IS NOT NULL)) AS f FROM shown)
SELECT CAST(len(f) AS BIGINT) AS field_count,
  0.5 * f[(len(f) + 1) // 2] + 0.5 * f[(len(f) + 2) // 2] AS median_recovery_pct,
  (SELECT round(list_sum(list(recovered_oil_mill_sm3)), 6) FROM shown) AS recovered_oil_mill_sm3,
  (SELECT round(list_sum(list(remaining_oe_mill_sm3_nonnegative)), 6) FROM shown) AS remaining_oe_mill_sm3,
  (SELECT list_max(list(reserve_version)) FROM shown) AS reserve_version,
  (SELECT strftime(list_max(list(loaded_at_utc)), '%Y-%m-%d %H:%M UTC') FROM shown) AS loaded_at
FROM factors
""",
)
def q_recovery_summary(spark, sf_dir):
    out = fr.recovery_summary(mart(spark, sf_dir), area="North sea", status="All statuses", hydrocarbon="no such type")
    return out.select(
        "field_count",
        "median_recovery_pct",
        F.round("recovered_oil_mill_sm3", 6).alias("recovered_oil_mill_sm3"),
        F.round("remaining_oe_mill_sm3", 6).alias("remaining_oe_mill_sm3"),
        "reserve_version",
        "loaded_at",
    )


@register(
    "recovery_ranking",
    f"""
WITH candidate AS (SELECT * FROM ({MART_SQL}) WHERE activity_status = 'Producing' AND oil_recovery_factor_pct IS NOT NULL)
SELECT c.field_name, c.activity_status,
  round(c.oil_recovery_factor_pct, 1) AS oil_recovery_factor_pct,
  round(c.inplace_oil_mill_sm3, 1) AS inplace_oil_mill_sm3,
  round(c.recoverable_oil_mill_sm3, 1) AS recoverable_oil_mill_sm3
FROM candidate AS c
LEFT JOIN candidate AS ahead ON ahead.oil_recovery_factor_pct > c.oil_recovery_factor_pct
  OR (ahead.oil_recovery_factor_pct = c.oil_recovery_factor_pct AND ahead.field_name < c.field_name)
GROUP BY c.field_name, c.activity_status, c.oil_recovery_factor_pct, c.inplace_oil_mill_sm3, c.recoverable_oil_mill_sm3
HAVING count(ahead.field_name) < {fr.RANKING_SIZE}
""",
)
def q_recovery_ranking(spark, sf_dir):
    return fr.recovery_ranking(mart(spark, sf_dir), status="Producing", ranking="Highest recovery")


@register(
    "recovery_ranking_lowest",
    f"""
WITH candidate AS (SELECT * FROM ({MART_SQL}) WHERE hydrocarbon_type = 'OIL/GAS' AND oil_recovery_factor_pct IS NOT NULL)
SELECT c.field_name, c.activity_status,
  round(c.oil_recovery_factor_pct, 1) AS oil_recovery_factor_pct,
  round(c.inplace_oil_mill_sm3, 1) AS inplace_oil_mill_sm3,
  round(c.recoverable_oil_mill_sm3, 1) AS recoverable_oil_mill_sm3
FROM candidate AS c
LEFT JOIN candidate AS ahead ON ahead.oil_recovery_factor_pct < c.oil_recovery_factor_pct
  OR (ahead.oil_recovery_factor_pct = c.oil_recovery_factor_pct AND ahead.field_name < c.field_name)
GROUP BY c.field_name, c.activity_status, c.oil_recovery_factor_pct, c.inplace_oil_mill_sm3, c.recoverable_oil_mill_sm3
HAVING count(ahead.field_name) < {fr.RANKING_SIZE}
""",
)
def q_recovery_ranking_lowest(spark, sf_dir):
    return fr.recovery_ranking(mart(spark, sf_dir), hydrocarbon="OIL/GAS", ranking="Lowest recovery")


@register(
    "remaining_opportunities",
    f"""
WITH candidate AS (SELECT * FROM ({MART_SQL}) WHERE remaining_oe_mill_sm3_nonnegative > 0)
SELECT c.field_name, c.main_area, c.operator_name, c.fact_page_url,
  round(any_value(c.remaining_oe_mill_sm3_nonnegative), 1) AS remaining_oe_mill_sm3,
  round(any_value(c.remaining_oil_mill_sm3), 1) AS remaining_oil_mill_sm3,
  round(any_value(c.produced_share_of_recoverable_oil_pct), 1) AS produced_share_pct
FROM candidate AS c
LEFT JOIN candidate AS ahead ON (ahead.remaining_oe_mill_sm3_nonnegative, c.field_name) > (c.remaining_oe_mill_sm3_nonnegative, ahead.field_name)
GROUP BY c.field_id, c.field_name, c.main_area, c.operator_name, c.fact_page_url
HAVING count(ahead.field_id) < {fr.OPPORTUNITY_SIZE}
""",
)
def q_remaining_opportunities(spark, sf_dir):
    return fr.remaining_opportunities(mart(spark, sf_dir))


# ====================================================================
# Pageview marts (M5-M7, A1, A6, P3, R1) on events as daily views
# ====================================================================
SUMMARY_AS_OF = td.EVENTS_AS_OF
TREND_AS_OF = "2024-02-10"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

DAILY_SQL = """
SELECT
  event_type AS project,
  'user_' || CAST(user_id AS VARCHAR) AS article,
  'all-access' AS access,
  'user' AS agent,
  'daily' AS granularity,
  CAST(ts AS DATE) AS viewed_on,
  CAST(count(*) AS BIGINT) AS views,
  max(ts) AS loaded_at_utc
FROM events
GROUP BY event_type, user_id, CAST(ts AS DATE)
"""

SUMMARY_SQL = f"""
SELECT key.project AS project, key.article AS article,
  days[1] AS first_viewed_on, days[-1] AS last_viewed_on,
  CAST(list_sum(counts) AS BIGINT) AS total_views,
  CAST(list_sum(counts) AS DOUBLE) / len(counts) AS avg_daily_views,
  CAST(ifnull(list_sum(recent), 0) AS BIGINT) AS views_last_7_days,
  loaded_at_utc
FROM (
  SELECT {{'project': project, 'article': article}} AS key,
    list(viewed_on ORDER BY viewed_on) AS days,
    list(views) AS counts,
    list(views) FILTER (WHERE date_diff('day', viewed_on, DATE '{SUMMARY_AS_OF}') <= 7) AS recent,
    list_max(list(loaded_at_utc)) AS loaded_at_utc
  FROM daily
  GROUP BY 1
) AS grouped
"""


def daily_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.pageviews_from_events(_t(spark, sf_dir, "events"))


@register("article_summary", f"WITH daily AS ({DAILY_SQL}) {SUMMARY_SQL}")
def q_article_summary(spark, sf_dir):
    return pv.article_summary(daily_views(spark, sf_dir), SUMMARY_AS_OF)


@register(
    "article_listing",
    f"""
WITH daily AS ({DAILY_SQL}), summary AS ({SUMMARY_SQL})
SELECT article, total_views, avg_daily_views, views_last_7_days,
  CAST(first_viewed_on AS VARCHAR) AS first_viewed_on,
  CAST(last_viewed_on AS VARCHAR) AS last_viewed_on,
  CAST(loaded_at_utc AS VARCHAR) AS loaded_at_utc
FROM summary
ORDER BY total_views DESC
""",
)
def q_article_listing(spark, sf_dir):
    return pv.summary_listing(pv.article_summary(daily_views(spark, sf_dir), SUMMARY_AS_OF))


@register(
    "daily_trend",
    f"""
WITH daily AS ({DAILY_SQL})
SELECT CAST(viewed_on AS VARCHAR) AS viewed_on, article, views
FROM daily
WHERE viewed_on >= DATE '{TREND_AS_OF}' - INTERVAL 30 DAY
ORDER BY viewed_on, article
""",
)
def q_daily_trend(spark, sf_dir):
    return pv.daily_trend(daily_views(spark, sf_dir), TREND_AS_OF)


@register(
    "daily_trend_wide",
    f"""
WITH daily AS ({DAILY_SQL})
SELECT CAST(viewed_on AS VARCHAR) AS viewed_on,
  """
    + ",\n  ".join(f"CAST(sum(views) FILTER (WHERE project = '{e}') AS BIGINT) AS {e}" for e in EVENT_TYPES)
    + f"""
FROM daily
WHERE viewed_on >= DATE '{TREND_AS_OF}' - INTERVAL 30 DAY
GROUP BY viewed_on
""",
)
def q_daily_trend_wide(spark, sf_dir):
    return pv.daily_trend_wide(daily_views(spark, sf_dir), TREND_AS_OF, EVENT_TYPES, column_key="project")


@register(
    "pageview_kpis",
    f"""
WITH daily AS ({DAILY_SQL}), summary AS ({SUMMARY_SQL}),
top AS (SELECT article, total_views, loaded_at_utc FROM summary ORDER BY total_views DESC, article, project LIMIT 1)
SELECT
  CAST(sum(total_views) AS BIGINT) AS total_views,
  CAST(sum(views_last_7_days) AS BIGINT) AS views_last_7_days,
  CAST(count(*) AS BIGINT) AS articles,
  (SELECT article FROM top) AS leading_article,
  (SELECT total_views FROM top) AS leading_views,
  (SELECT loaded_at_utc FROM top) AS leading_loaded_at_utc
FROM summary
""",
)
def q_pageview_kpis(spark, sf_dir):
    return pv.pageview_kpis(pv.article_summary(daily_views(spark, sf_dir), SUMMARY_AS_OF))


# ====================================================================
# Starter marts (M8, M9, S5, A2) on events as dense daily metric counts
# ====================================================================
SERIES_AS_OF = "2024-01-30"
SERIES_DAYS = 14

SERIES_SQL = f"""
SELECT metric, CAST(day AS DATE) AS measured_on,
  CAST(ifnull(list_sum(element_at(seen, CAST(day AS DATE))), 0) AS BIGINT) AS value,
  TIMESTAMP '{td.FIELDS_LOADED_AT}' AS loaded_at_utc
FROM (
  SELECT event_type AS metric, histogram(CAST(ts AS DATE)) AS seen,
    unnest(generate_series(TIMESTAMP '{SERIES_AS_OF}' - INTERVAL {SERIES_DAYS - 1} DAY, TIMESTAMP '{SERIES_AS_OF}', INTERVAL 1 DAY)) AS day
  FROM events
  WHERE event_type IS NOT NULL
  GROUP BY event_type
) AS dense
"""


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.dense_daily_counts(_t(spark, sf_dir, "events"), "event_type", "ts", SERIES_AS_OF, SERIES_DAYS, td.FIELDS_LOADED_AT)


@register("metric_daily_series", SERIES_SQL)
def q_metric_daily_series(spark, sf_dir):
    return metric_series(spark, sf_dir)


METRIC_SQL = f"""
WITH ordered AS (
  SELECT metric, list(value ORDER BY measured_on) AS v, list(measured_on ORDER BY measured_on) AS d, list_max(list(loaded_at_utc)) AS loaded_at_utc
  FROM ({SERIES_SQL}) GROUP BY metric
)
SELECT metric, CAST(v[-1] AS BIGINT) AS current_value,
  CAST(list_min(v) AS BIGINT) AS min_value, CAST(list_max(v) AS BIGINT) AS max_value,
  CAST(round(CAST(list_sum(v) AS DOUBLE) / len(v), 2) AS DOUBLE) AS avg_value, CAST(list_sum(v) AS BIGINT) AS total_value,
  d[1] AS first_measured_on, d[-1] AS last_measured_on, loaded_at_utc
FROM ordered
"""


@register("metric_summary", METRIC_SQL)
def q_metric_summary(spark, sf_dir):
    return st.starter_metric_summary(metric_series(spark, sf_dir))


def _load_all() -> None:
    import tablework.queries_ops  # noqa: F401  (registers operator queries)
    import tablework.queries_plans  # noqa: F401  (registers plan and function queries)
    import tablework.queries_jobs  # noqa: F401  (registers end-to-end job queries)


def _in_utc(fn: QueryFn) -> QueryFn:
    """Timestamps of the data model are UTC: pin the session zone so the
    results do not depend on the caller's session settings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


@register(
    "metric_listing",
    f"""
SELECT metric, current_value, avg_value, total_value,
  COLUMNS(['first_measured_on', 'last_measured_on', 'loaded_at_utc'])::VARCHAR
FROM ({METRIC_SQL})
""",
)
def q_metric_listing(spark, sf_dir):
    return st.summary_listing(st.starter_metric_summary(metric_series(spark, sf_dir)))


@register(
    "metric_daily_listing",
    f"""
WITH daily AS ({SERIES_SQL})
SELECT CAST(measured_on AS VARCHAR) AS measured_on, metric, value
FROM daily
ORDER BY measured_on, metric
""",
)
def q_metric_daily_listing(spark, sf_dir):
    return st.daily_listing(metric_series(spark, sf_dir))


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {name: _in_utc(fn) for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}

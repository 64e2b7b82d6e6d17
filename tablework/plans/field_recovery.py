"""Field-recovery marts (M1-M4).

``field_recovery_latest`` is the flagship: latest reserve estimate per
field (W1), left-joined to the field table (J1), with guarded ratios and
clamped shares (P6-P9).  The dashboard queries (M2-M4) filter it by
validated choices (P2) and rank it (T1).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import clamp_pct, guarded_ratio, newest, nonneg_diff
from tablework.operators.aggregates import kpi_row
from tablework.operators.filters import choice_filter
from tablework.operators.shape import top_k
from tablework.operators.windows import latest_per_key

# Hydrocarbon classes that carry oil.
OIL_TYPES = ("OIL", "OIL/GAS", "OIL/CONDENSATE")

# Dashboard choices (first entry is the ALL value).
AREAS = ("All areas", "North sea", "Norwegian sea", "Barents sea")
STATUSES = ("All statuses", "Producing", "Approved for production", "Shut down")
HYDROCARBON_TYPES = ("All types", "OIL", "OIL/GAS", "GAS", "GAS/CONDENSATE", "OIL/CONDENSATE")
RANKINGS = ("Highest recovery", "Lowest recovery")

# Dashboard list sizes.
RANKING_SIZE = 18
OPPORTUNITY_SIZE = 7

FIELD_COLUMNS = (
    "field_id",
    "field_name",
    "activity_status",
    "discovery_year",
    "operator_name",
    "hydrocarbon_type",
    "main_area",
    "fact_page_url",
    "source_updated_at",
)
RESERVE_MEASURES = (
    "recoverable_oil_mill_sm3",
    "recoverable_gas_bill_sm3",
    "recoverable_ngl_mill_tonnes",
    "recoverable_condensate_mill_sm3",
    "recoverable_oe_mill_sm3",
    "remaining_oil_mill_sm3",
    "remaining_gas_bill_sm3",
    "remaining_ngl_mill_tonnes",
    "remaining_condensate_mill_sm3",
    "remaining_oe_mill_sm3",
    "inplace_oil_mill_sm3",
    "inplace_associated_liquid_mill_sm3",
    "inplace_associated_gas_bill_sm3",
    "inplace_free_gas_bill_sm3",
)


def latest_reserve(history: DataFrame) -> DataFrame:
    """Newest estimate per field by version, then estimate date (both
    NULLs last), then object id."""
    return latest_per_key(
        history,
        ["field_id"],
        [
            F.col("reserve_version").desc_nulls_last(),
            F.col("official_estimate_date").desc_nulls_last(),
            F.col("object_id").desc_nulls_last(),
        ],
    )


def field_recovery_latest(fields: DataFrame, history: DataFrame, oil_types: Sequence[str] = OIL_TYPES) -> DataFrame:
    """M1: 31-column latest-recovery view.

    The field side is not de-duplicated (a repeated field id yields two
    rows); reserve rows with a NULL field id never match.
    """
    r = latest_reserve(history).alias("r")
    f = fields.alias("f")
    j = f.join(r, F.col("f.field_id") == F.col("r.field_id"), "left")
    rc = lambda c: F.col(f"r.{c}")
    oil_bearing = F.col("f.hydrocarbon_type").isin(list(oil_types))
    return j.select(
        *[F.col(f"f.{c}").alias(c) for c in FIELD_COLUMNS],
        rc("reserve_version").alias("reserve_version"),
        rc("official_estimate_date").alias("official_estimate_date"),
        *[rc(c).alias(c) for c in RESERVE_MEASURES],
        guarded_ratio(rc("recoverable_oil_mill_sm3"), rc("inplace_oil_mill_sm3"), oil_bearing).alias("oil_recovery_factor_pct"),
        nonneg_diff(rc("recoverable_oil_mill_sm3"), rc("remaining_oil_mill_sm3")).alias("recovered_oil_mill_sm3"),
        clamp_pct(rc("recoverable_oil_mill_sm3"), rc("remaining_oil_mill_sm3")).alias("produced_share_of_recoverable_oil_pct"),
        nonneg_diff(rc("recoverable_oe_mill_sm3"), rc("remaining_oe_mill_sm3")).alias("recovered_oe_mill_sm3"),
        nonneg_diff(rc("remaining_oe_mill_sm3")).alias("remaining_oe_mill_sm3_nonnegative"),
        newest(F.col("f.loaded_at_utc"), rc("loaded_at_utc")).alias("loaded_at_utc"),
    )


def _choices(area: str | None, status: str | None, hydrocarbon: str | None, areas=AREAS, statuses=STATUSES, types=HYDROCARBON_TYPES) -> Mapping:
    return {
        "main_area": (area, areas, areas[0]),
        "activity_status": (status, statuses, statuses[0]),
        "hydrocarbon_type": (hydrocarbon, types, types[0]),
    }


def recovery_summary(mart: DataFrame, area: str | None = None, status: str | None = None, hydrocarbon: str | None = None) -> DataFrame:
    """M2: KPI row of the filtered mart."""
    filtered = choice_filter(mart, _choices(area, status, hydrocarbon))
    return kpi_row(
        filtered,
        "oil_recovery_factor_pct",
        [("recovered_oil_mill_sm3", "recovered_oil_mill_sm3"), ("remaining_oe_mill_sm3_nonnegative", "remaining_oe_mill_sm3")],
        "reserve_version",
        "loaded_at_utc",
    )


def recovery_ranking(
    mart: DataFrame,
    area: str | None = None,
    status: str | None = None,
    hydrocarbon: str | None = None,
    ranking: str | None = None,
    k: int = RANKING_SIZE,
) -> DataFrame:
    """M3: top fields by recovery factor (direction chosen, tie on name)."""
    picked = ranking if ranking in RANKINGS else RANKINGS[0]
    filtered = choice_filter(mart, _choices(area, status, hydrocarbon)).where(F.col("oil_recovery_factor_pct").isNotNull())
    top = top_k(filtered, "oil_recovery_factor_pct", k, desc=picked == RANKINGS[0], tie=["field_name"])
    return top.select(
        "field_name",
        F.round("oil_recovery_factor_pct", 1).alias("oil_recovery_factor_pct"),
        F.round("inplace_oil_mill_sm3", 1).alias("inplace_oil_mill_sm3"),
        F.round("recoverable_oil_mill_sm3", 1).alias("recoverable_oil_mill_sm3"),
        "activity_status",
    )


def remaining_opportunities(
    mart: DataFrame,
    area: str | None = None,
    status: str | None = None,
    hydrocarbon: str | None = None,
    k: int = OPPORTUNITY_SIZE,
) -> DataFrame:
    """M4: fields with the most remaining oil equivalent."""
    filtered = choice_filter(mart, _choices(area, status, hydrocarbon)).where(F.col("remaining_oe_mill_sm3_nonnegative") > 0)
    top = top_k(filtered, "remaining_oe_mill_sm3_nonnegative", k, desc=True, tie=["field_name"])
    return top.select(
        "field_name",
        "main_area",
        "operator_name",
        F.round("remaining_oe_mill_sm3_nonnegative", 1).alias("remaining_oe_mill_sm3"),
        F.round("remaining_oil_mill_sm3", 1).alias("remaining_oil_mill_sm3"),
        F.round("produced_share_of_recoverable_oil_pct", 1).alias("produced_share_pct"),
        "fact_page_url",
    )


# ---------------------------------------------------------------- load job
def load_field_recovery(
    spark,
    store,
    fields_path,
    reserves_path,
    source_service: str,
    loaded_at,
    multiline: bool = True,
) -> tuple[int, int, int]:
    """Load field and reserve JSON into ``fields`` and
    ``field_reserve_history``, and append one ``ingestion_runs`` row, all
    in one publish (K6): a missing source column, a bad cast, an empty
    source or an all-NULL version fails the load and leaves the previous
    tables and audit untouched.  Returns (field rows, reserve rows, latest
    version)."""
    from tablework.contracts import FIELDS, FIELDS_EPOCH_TS, RESERVES, RESERVES_EPOCH_DATE
    from tablework.operators.aggregates import load_stats
    from tablework.operators.quality import ContractError, require_rows
    from tablework.sources.json_scan import read_json_table

    loaded_text = loaded_at.strftime("%Y-%m-%d %H:%M:%S") if hasattr(loaded_at, "strftime") else str(loaded_at)
    stamp = F.to_timestamp(F.lit(loaded_text))
    fields = read_json_table(spark, str(fields_path), FIELDS, epoch_ts=FIELDS_EPOCH_TS, multiline=multiline).withColumn("loaded_at_utc", stamp)
    reserves = read_json_table(spark, str(reserves_path), RESERVES, epoch_date=RESERVES_EPOCH_DATE, multiline=multiline).withColumn("loaded_at_utc", stamp)
    require_rows(fields, "fields")
    require_rows(reserves, "reserves")
    result: dict = {}

    def stats_check(staged):
        row = load_stats(staged["fields"], staged["field_reserve_history"]).first()
        if row["latest_reserve_version"] is None:
            raise ContractError("reserve history has no version")
        result.update(row.asDict())

    def audit_row(staged):
        # built from literals of the checked statistics (no driver rows)
        return spark.range(1).select(
            stamp.alias("loaded_at_utc"),
            F.lit(source_service).alias("source_service"),
            F.lit(result["field_rows"]).cast("bigint").alias("field_rows"),
            F.lit(result["reserve_history_rows"]).cast("bigint").alias("reserve_history_rows"),
            F.lit(result["latest_reserve_version"]).cast("int").alias("latest_reserve_version"),
        )

    store.publish(
        {"fields": fields, "field_reserve_history": reserves},
        checks=[stats_check],
        appends={"ingestion_runs": audit_row},
    )
    return int(result["field_rows"]), int(result["reserve_history_rows"]), int(result["latest_reserve_version"])


def field_recovery_view(store) -> DataFrame:
    """K2: the latest-recovery view over the published tables."""
    return field_recovery_latest(store.read("fields"), store.read("field_reserve_history"))

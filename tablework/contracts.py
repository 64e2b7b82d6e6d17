"""Column contracts of the data model.

A contract is an ordered list of ``(source_name, spark_type, target_name)``.
Sources are read with inferred (or raw) names, checked against the
contract (Q5) and then projected with ``select(cast.alias)`` (P1).
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

Contract = list[tuple[str, str, str]]

_TYPES: dict[str, DataType] = {
    "bigint": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "date": DateType(),
    "timestamp": TimestampType(),
    "boolean": BooleanType(),
}


def spark_type(name: str) -> DataType:
    return _TYPES[name]

# Source names and target names of the field layer.
FIELDS: Contract = [
    ("OBJECTID", "bigint", "object_id"),
    ("fldNpdidField", "bigint", "field_id"),
    ("fldName", "string", "field_name"),
    ("fldCurrentActivitySatus", "string", "activity_status"),
    ("fldDiscoveryYear", "int", "discovery_year"),
    ("cmpLongName", "string", "operator_name"),
    ("fldHcType", "string", "hydrocarbon_type"),
    ("fldMainArea", "string", "main_area"),
    ("fldFactPageUrl", "string", "fact_page_url"),
    ("fldDateUpdatedMax", "bigint", "source_updated_at"),
]

# Source names and target names of the reserve layer.
RESERVES: Contract = [
    ("OBJECTID", "bigint", "object_id"),
    ("fldNpdidField", "bigint", "field_id"),
    ("fldVersion", "int", "reserve_version"),
    ("fldDateOffResEstDisplay", "bigint", "official_estimate_date"),
    ("fldRecoverableOil", "double", "recoverable_oil_mill_sm3"),
    ("fldRecoverableGas", "double", "recoverable_gas_bill_sm3"),
    ("fldRecoverableNGL", "double", "recoverable_ngl_mill_tonnes"),
    ("fldRecoverableCondensate", "double", "recoverable_condensate_mill_sm3"),
    ("fldRecoverableOE", "double", "recoverable_oe_mill_sm3"),
    ("fldRemainingOil", "double", "remaining_oil_mill_sm3"),
    ("fldRemainingGas", "double", "remaining_gas_bill_sm3"),
    ("fldRemainingNGL", "double", "remaining_ngl_mill_tonnes"),
    ("fldRemainingCondensate", "double", "remaining_condensate_mill_sm3"),
    ("fldRemainingOE", "double", "remaining_oe_mill_sm3"),
    ("fldInplaceOil", "double", "inplace_oil_mill_sm3"),
    ("fldInplaceAssLiquid", "double", "inplace_associated_liquid_mill_sm3"),
    ("fldInplaceAssGas", "double", "inplace_associated_gas_bill_sm3"),
    ("fldInplaceFreeGas", "double", "inplace_free_gas_bill_sm3"),
]

# Columns converted from epoch milliseconds after the cast.
FIELDS_EPOCH_TS = ("source_updated_at",)
RESERVES_EPOCH_DATE = ("official_estimate_date",)

# The daily pageview table (K3), its NOT NULL columns and key.
PAGEVIEWS_DAILY = StructType(
    [
        StructField("project", StringType(), False),
        StructField("article", StringType(), False),
        StructField("access", StringType(), False),
        StructField("agent", StringType(), False),
        StructField("granularity", StringType(), False),
        StructField("viewed_on", DateType(), False),
        StructField("views", LongType(), False),
        StructField("loaded_at_utc", TimestampType(), False),
    ]
)
PAGEVIEWS_KEY = ("project", "article", "access", "agent", "viewed_on")

# The load audit row (K4).
INGESTION_RUNS = "loaded_at_utc timestamp, source_service string, field_rows bigint, reserve_history_rows bigint, latest_reserve_version int"


def source_schema(contract: Contract) -> StructType:
    """Read schema in source names (used for JSON scans)."""
    return StructType([StructField(src, spark_type(t), True) for src, t, _ in contract])

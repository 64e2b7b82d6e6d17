"""Field-recovery load and marts on the golden fixture (FX1, FX2, FX3, FX5)."""

import datetime as dt
import json

import pytest

from tablework.contracts import FIELDS, RESERVES
from tablework.operators.quality import ContractError
from tablework.plans import field_recovery as fr
from tablework.sinks.store import TableStore
from tablework.sources.json_scan import PageError, unnest_pages

LOADED = dt.datetime(2031, 5, 6, 7, 8, 9)
UPDATED = dt.datetime(2030, 3, 1)
SAMPLE = {"bigint": 11, "int": 2001, "string": "some text", "double": 0.0, "date": None}


def source_rows(contract, *changes):
    """Landed rows of a layer: a sample value per contract column, then the
    changes, which are named by the contract's target columns."""
    source = {target: name for name, _, target in contract}
    rows = []
    for number, change in enumerate(changes, 1):
        row = {name: SAMPLE[kind] for name, kind, _ in contract} | {source["object_id"]: 700 + number}
        for target in ("source_updated_at", "official_estimate_date"):
            if target in source:
                row[source[target]] = int(UPDATED.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        rows.append(row | {source[target]: value for target, value in change.items()})
    return rows


def field(number, name, **more):
    return {"field_id": number, "field_name": name, "hydrocarbon_type": "OIL", "main_area": "Barents sea", "activity_status": "Producing"} | more


def estimate(number, version, recoverable, remaining, inplace, **more):
    return {"field_id": number, "reserve_version": version, "recoverable_oil_mill_sm3": recoverable, "remaining_oil_mill_sm3": remaining, "inplace_oil_mill_sm3": inplace} | more


class Landing:
    """Two landed layers and the store they are loaded into."""

    def __init__(self, spark, folder):
        self.spark, self.store = spark, TableStore(spark, str(folder / "store"))
        self.paths = [folder / "layer_a.json", folder / "layer_b.json"]

    def load(self, fields, reserves):
        for path, rows in zip(self.paths, (fields, reserves), strict=True):
            path.write_text(json.dumps(rows), encoding="utf-8")
        return fr.load_field_recovery(self.spark, self.store, *self.paths, "landing service", LOADED)


@pytest.fixture()
def landing(spark, tmp_path):
    return Landing(spark, tmp_path)


def by_name(df, *columns):
    return {r["field_name"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_the_newest_estimate_decides_the_metrics(landing):
    # Skarv: 21 of 28 recoverable of 35 in place remain; an older version and an
    # older date of the same version do not count.  Tor has no estimate at all.
    fields = source_rows(FIELDS, field(5, "Skarv"), field(6, "Heidrun", hydrocarbon_type="GAS/CONDENSATE"), field(7, "Tor"), field(8, "Odin", hydrocarbon_type="OIL/GAS"))
    reserves = source_rows(
        RESERVES, estimate(5, 2019, 99, 1, 100), estimate(5, 2023, 28, 21, 35), estimate(6, 2021, 8, 6, 32), estimate(8, 2023, 16, 24, 64), estimate(8, None, 1, 1, 1)
    )
    assert landing.load(fields, reserves) == (4, 5, 2023)
    view = fr.field_recovery_view(landing.store)
    got = by_name(view, "reserve_version", "oil_recovery_factor_pct", "produced_share_of_recoverable_oil_pct", "recovered_oil_mill_sm3")
    assert got == {
        "Skarv": (2023, 80.0, 25.0, 7.0),
        "Heidrun": (2021, None, 25.0, 2.0),  # no oil field: no recovery factor
        "Tor": (None, None, None, 0.0),
        "Odin": (2023, 25.0, 0.0, 0.0),  # more remaining than recoverable
    }
    assert {r[0] for r in view.select("source_updated_at").collect()} == {UPDATED}
    assert landing.store.read("ingestion_runs").count() == 1


def test_a_load_that_fails_changes_nothing(landing):
    landing.load(source_rows(FIELDS, field(1, "Frigg")), source_rows(RESERVES, estimate(1, 2020, 4, 2, 8)))
    before, version = landing.store.read("fields").collect(), landing.store.version()
    other = source_rows(FIELDS, field(2, "Gyda"))
    with pytest.raises(ContractError):
        landing.load(other, [{"unexpected": "layout"}])
    assert landing.store.version() == version
    assert landing.store.read("fields").collect() == before
    assert landing.store.read("ingestion_runs").count() == 1


def test_a_value_that_cannot_be_cast_fails_the_load(landing):
    with pytest.raises(Exception):
        landing.load(source_rows(FIELDS, field(1, "Frigg", discovery_year="nineteen")), source_rows(RESERVES, estimate(1, 2020, 4, 2, 8)))
    assert landing.store.version() == 0


def test_reserves_without_any_version_fail_the_load(landing):
    with pytest.raises(ContractError, match="no version"):
        landing.load(source_rows(FIELDS, field(1, "Frigg")), source_rows(RESERVES, estimate(1, None, 4, 2, 8)))
    assert landing.store.version() == 0


def test_dashboard_rows_of_the_loaded_mart(landing):
    names = ["Balder", "Draugen", "Embla", "Fram"]
    fields = source_rows(FIELDS, *(field(k, n) for k, n in enumerate(names)))
    # factors 20, 40, 60 and 70 per cent
    reserves = source_rows(RESERVES, *(estimate(k, 2022, r, 1, 10) for k, r in enumerate((2, 4, 6, 7))))
    landing.load(fields, reserves)
    mart = fr.field_recovery_view(landing.store)
    kpi = fr.recovery_summary(mart, area="no such area").first()
    assert (kpi["field_count"], kpi["loaded_at"]) == (4, "2031-05-06 07:08 UTC")
    assert kpi["median_recovery_pct"] == pytest.approx(50.0)
    assert [r["field_name"] for r in fr.recovery_ranking(mart, ranking="Lowest recovery").collect()] == names


def _pages(spark, payloads):
    rows = [json.dumps(p) for p in payloads]
    rdd = spark.sparkContext.parallelize(rows, 2)
    return spark.read.schema("features string, exceededTransferLimit boolean, error string").json(rdd)


def test_unnest_pages_two_pages(spark):
    pages = _pages(spark, [
        {"features": [{"attributes": {"OBJECTID": 1}}], "exceededTransferLimit": True},
        {"features": [{"attributes": {"OBJECTID": 2}}, "junk", {"no": 1}], "exceededTransferLimit": False},
    ])
    rows = unnest_pages(pages, [("OBJECTID", "bigint", "object_id")])
    assert sorted(r["OBJECTID"] for r in rows.collect()) == [1, 2]


@pytest.mark.parametrize(
    "payloads, message",
    [
        ([{"error": {"code": 400}, "features": []}], "API error"),
        ([{"features": [], "exceededTransferLimit": True}], "more data"),
        ([{"features": []}, {}], "no rows"),
        ([{"features": {"attributes": {"OBJECTID": 1}}}], "not a list"),
    ],
)
def test_unnest_pages_errors(spark, payloads, message):
    with pytest.raises(PageError, match=message):
        unnest_pages(_pages(spark, payloads), [("OBJECTID", "bigint", "object_id")])


def test_unnest_pages_missing_contract_column(spark):
    pages = _pages(spark, [{"features": [{"attributes": {"OBJECTID": 1}}]}])
    with pytest.raises(ContractError):
        unnest_pages(pages, FIELDS)
    assert RESERVES[0][0] == "OBJECTID"


def test_unnest_pages_read_with_inference(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    (d / "p1.json").write_text(json.dumps({"features": [{"attributes": {"OBJECTID": 1}}], "exceededTransferLimit": True}))
    (d / "p2.json").write_text(json.dumps({"features": [{"attributes": {"OBJECTID": 2}}], "exceededTransferLimit": False}))
    pages = spark.read.json(str(d))  # features inferred as array<struct>
    rows = unnest_pages(pages, [("OBJECTID", "bigint", "object_id")])
    assert sorted(r["OBJECTID"] for r in rows.collect()) == [1, 2]

"""Small sources and checks: whole-text scan (S4), parameterised SQL (S10),
contract checks (Q5), listing (T3), JSON lines scan (S1)."""

import json

import pytest
from pyspark.sql import functions as F

from tablework.contracts import Contract
from tablework.operators import quality as q
from tablework.operators import shape
from tablework.sources.catalog import catalog_inventory, inventory_summary, run_sql
from tablework.sources.json_scan import read_json_table, read_whole_text


def test_read_whole_text_drops_lines(spark, tmp_path):
    (tmp_path / "a.sql").write_text("select 1;\n-- managed by tool\nselect 2;\n")
    (tmp_path / "b.sql").write_text("-- managed by tool")
    df = read_whole_text(spark, str(tmp_path / "*.sql"), drop_line_pattern="managed by tool")
    got = sorted(r["content"] for r in df.collect())
    assert got == ["", "select 1;\nselect 2;\n"]


def test_run_sql_parameters(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert run_sql(spark, "SELECT count(*) FROM ten WHERE id >= :lo", {"lo": 7}).first()[0] == 3
    assert run_sql(spark, "SELECT count(*) FROM ten WHERE id < ?", [2]).first()[0] == 2


def test_contract_checks(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert q.check_contract(df.schema, ["a", "c"]) == ["missing column c"]
    assert q.check_contract(df.schema, ["a"], closed=True) == ["unknown column b"]
    with pytest.raises(q.ContractError):
        q.check_contract_keys({"a"}, ["a", "b"])
    with pytest.raises(q.EmptySourceError):
        q.require_rows(df.limit(0))


def test_json_lines_scan_and_types(spark, tmp_path):
    p = tmp_path / "rows.json"
    p.write_text("\n".join(json.dumps(r) for r in [{"ID": 1, "V": "2.5", "T": 1735689600000}, {"ID": 2, "V": None, "T": None}]))
    contract: Contract = [("ID", "bigint", "id"), ("V", "double", "value"), ("T", "bigint", "ts")]
    rows = read_json_table(spark, str(p), contract, epoch_ts=("ts",), multiline=False).orderBy("id").collect()
    assert rows[0]["value"] == 2.5 and rows[1]["value"] is None
    assert str(rows[0]["ts"]) == "2025-01-01 00:00:00" and rows[1]["ts"] is None


def test_listing_page(spark):
    df = spark.range(10).select(F.col("id"))
    got = [r["id"] for r in shape.page(df, [F.col("id").desc()], 3, 2).collect()]
    assert got == [7, 6, 5]


def test_catalog_inventory(spark):
    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("inv_a")
    spark.range(1).createOrReplaceTempView("inv_b")
    inv = catalog_inventory(spark, ["inv_a", "inv_b"])
    got = sorted((r["table_name"], r["column_count"]) for r in inv.collect())
    assert got == [("inv_a", 2), ("inv_b", 1)]
    s = inventory_summary(inv).first()
    assert (s["schemas"], s["columns"], s["tables"]) == (1, 3, 2)


def test_scale_conf_sizes_partitions():
    from tablework.session import scale_conf

    big = scale_conf(100 << 40)  # 100 TB
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 256 << 20
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    small = scale_conf(10 << 20)
    assert small["spark.sql.shuffle.partitions"] == "200"
    tight = scale_conf(1 << 40, executor_memory_bytes=4 << 30, executor_cores=8)
    assert int(tight["spark.sql.files.maxPartitionBytes"]) == 128 << 20


def test_read_whole_binary(spark, tmp_path):
    from tablework.sources.json_scan import read_whole_binary

    (tmp_path / "a.txt").write_text("héllo\nwörld")
    row = read_whole_binary(spark, str(tmp_path / "*.txt")).first()
    assert row["content"] == "héllo\nwörld" and row["length"] == len("héllo\nwörld".encode())


def test_session_variables(spark):
    from tablework.sources.catalog import set_variables

    spark.range(10).createOrReplaceTempView("ten_v")
    set_variables(spark, {"lo_bound": 6, "label": "x'; DROP"})
    row = run_sql(spark, "SELECT count(*) AS n, max(label) AS l FROM ten_v WHERE id >= lo_bound").first()
    assert (row["n"], row["l"]) == (4, "x'; DROP")


def test_sorts_put_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r["x"] for r in shape.total_sort(df, "x").collect()] == [1, 3, None]
    assert [r["x"] for r in shape.total_sort(df, ("x", True)).collect()] == [3, 1, None]
    assert [r["x"] for r in shape.top_k(df, "x", 2, desc=True).collect()] == [3, 1]
    u = shape.distinct_union([df, df.where("x = 1")])
    assert sorted((r["x"] for r in u.collect()), key=lambda v: (v is None, v)) == [1, 3, None]


def test_page_values_are_cast_strictly(spark):
    import pytest

    from tablework.sources.json_scan import unnest_pages

    contract = [("OBJECTID", "bigint", "object_id"), ("fldName", "string", "name")]

    def pages(*texts):
        return spark.createDataFrame([(t,) for t in texts], "features string")

    good = pages('[{"attributes": {"OBJECTID": "7", "fldName": "a"}}, {"attributes": {"OBJECTID": 8.0, "fldName": null}}]')
    assert sorted((r.OBJECTID, r.fldName) for r in unnest_pages(good, contract).collect()) == [(7, "a"), (8, None)]
    with pytest.raises(Exception, match="cannot be cast"):
        unnest_pages(pages('[{"attributes": {"OBJECTID": "abc", "fldName": "a"}}]'), contract).collect()
    with pytest.raises(Exception):
        unnest_pages(pages('[{"attributes": {"OBJECTID": 1, "fldName": "a"}}, {"attri'), contract).collect()

"""Scale guard: no registered query plans a nested-loop join, a cartesian
product or a Python UDF, and filtered scans push their filters down."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# these run Spark jobs while building (loops, load jobs, the KPI row)
EAGER = ("catalog_inventory", "op", "pipeline")  # the corpus operators run jobs while they are built; tests/llm looks at them
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith(EAGER)))
def test_plan_has_no_red_flags(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan], plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = entry.queries()["field_recovery_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "o_clerk" not in plan and "o_orderkey" in plan


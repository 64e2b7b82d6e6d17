"""Property tests: exact median and keyed upsert against plain Python."""

import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablework.operators.aggregates import exact_median
from tablework.sinks.store import upsert_frame

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=0, max_size=300), st.booleans())
def test_exact_median_matches_python(spark, values, narrow):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    clean = [float(v) for v in values if v is not None]
    got = exact_median(df, "x")
    if not clean:
        assert got is None
    else:
        assert got == statistics.median(clean)


@SETTINGS
@given(
    st.dictionaries(st.integers(0, 30), st.integers(0, 9), max_size=25),
    st.dictionaries(st.integers(0, 30), st.integers(10, 19), max_size=25),
)
def test_upsert_matches_dict_update(spark, target, incoming):
    t = spark.createDataFrame(list(target.items()), "k int, v int")
    i = spark.createDataFrame(list(incoming.items()), "k int, v int")
    got = dict(tuple(r) for r in upsert_frame(t, i, ["k"]).collect())
    want = dict(target)
    want.update(incoming)
    assert got == want

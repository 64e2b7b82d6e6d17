"""Landed page files (S2) and files larger than a split."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tablework.sources import json_scan as js

CONTRACT = [("OBJECTID", "bigint", "object_id"), ("v", "string", "v")]
PAGES = "layer string, resultOffset long, features string, exceededTransferLimit boolean, error string, landed long"


def page(spark_rows, offset, ids, more, layer="a", landed=0, error=None):
    features = json.dumps([{"attributes": {"OBJECTID": i, "v": f"{layer}{i}"}} for i in ids])
    spark_rows.append((layer, offset, features, more, error, landed))
    return spark_rows


def stitch(spark, rows):
    out = js.stitch_pages(spark.createDataFrame(rows, PAGES).repartition(3), CONTRACT, "OBJECTID", series_col="layer", landed_col="landed")
    return sorted((r["series"], r["OBJECTID"], r["v"]) for r in out.collect())


def ids(*pairs):
    return sorted((layer, i, f"{layer}{i}") for layer, found in pairs for i in found)


def test_overlaps_and_repeated_pages_are_removed(spark):
    rows = page([], 0, [1, 2, 3], True)
    page(rows, 2, [3, 5, 8], True)  # one row again
    page(rows, 2, [3, 5, 8], True, landed=1)  # landed twice
    page(rows, 5, [9], False)
    page(rows, 0, [4, 6], False, layer="b")
    assert stitch(spark, rows) == ids(("a", [1, 2, 3, 5, 8, 9]), ("b", [4, 6]))


def test_a_page_that_was_landed_longer_adds_its_new_rows(spark):
    rows = page([], 0, [1, 2], True)
    page(rows, 0, [1, 2, 3, 4], True, landed=1)
    page(rows, 4, [5], False)
    assert stitch(spark, rows) == ids(("a", [1, 2, 3, 4, 5]))


@pytest.mark.parametrize(
    ("pages", "message"),
    [
        ([(0, [1, 2], True), (3, [4], False)], "rows are missing before the page at offset 3 of a"),
        ([(1, [2], False)], "rows are missing before the page at offset 1 of a"),
        ([(0, [1, 2], True), (2, [3], True)], "the last page announces more rows of a"),
        ([(0, [1, 2], False), (2, [3], False)], "a page follows the last one at offset 2 of a"),
        ([(0, [1, 5], True), (2, [4], False)], "ids do not rise in the page at offset 2 of a"),
        ([(0, [1], True), (1, [], True)], "a page indicated more data but returned no rows"),
    ],
)
def test_broken_series_are_refused(spark, pages, message):
    rows = []
    for offset, found, more in pages:
        page(rows, offset, found, more)
    page(rows, 0, [7], False, layer="z")
    with pytest.raises(js.PageError, match=message):
        stitch(spark, rows)


def test_page_errors_are_raised(spark):
    with pytest.raises(js.PageError, match="API error"):
        stitch(spark, page([], 0, [1], False, error='{"code": 500}'))


def test_a_long_series_over_many_ranges(spark):
    rng, rows, at = random.Random(4), [], 0
    while at < 900:
        start = max(0, at - rng.randint(0, 4))
        end = min(900, at + rng.randint(1, 9))
        page(rows, start, range(start * 2, end * 2, 2), end < 900, landed=rng.randint(0, 3))
        at = end
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert stitch(spark, rows) == ids(("a", range(0, 1800, 2)))
        del rows[100:104]
        with pytest.raises(js.PageError, match="rows are missing"):
            stitch(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_files_larger_than_a_split_keep_every_line(spark, workdir):
    rng = random.Random(9)
    texts = {
        "a.txt": "\n".join("".join(rng.choice("ab é\r\t") for _ in range(rng.randint(0, 90))) for _ in range(800)),
        "b.txt": "first\r\nsecond\n\n\nlicense here\nlast\n",
        "c.txt": "one line" * 2000,
    }
    for name, text in texts.items():
        with open(os.path.join(workdir, name), "w", encoding="utf-8", newline="") as fh:
            fh.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        lines = js.read_lines(spark, workdir)
        assert lines.rdd.getNumPartitions() > 10
        rows = sorted(lines.collect(), key=lambda r: (r["path"], r["block"], r["at"]))
        ends = {r["path"].rsplit("/", 1)[1]: (r["n_lines"], r["ends_with_newline"]) for r in js.line_stats(lines).collect()}
        dropped = js.read_lines(spark, workdir, "license").where(F.col("path").endswith("b.txt")).orderBy("block", "at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        mine = [r["line"] for r in rows if r["path"].endswith(name)]
        assert "\n".join(mine) + ("\n" if ends[name][1] else "") == text
        assert ends[name] == (len(mine), text.endswith("\n"))
    assert [r["line"] for r in dropped] == ["first\r", "second", "", "", "last"]

"""Connected components of a table of links, as repeated DataFrame joins.

Every round each node takes the smallest label among itself, its neighbours
and its label's own label (hooking and pointer jumping), so long chains shrink
quickly.  A round is two shuffles of narrow rows with partial aggregation; its
result is written to the shared folder, and only a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b: long); the label is the
    smallest node reachable.  Null ends are ignored."""
    both = links.dropna().select("a", "b").unionByName(links.dropna().select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges = materialise(both, "links")
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label")
    labels = materialise(labels, "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        # what a label's node has found also holds for the nodes under that label
        found = hooked.groupBy("label").agg(F.min("low").alias("found"))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        after = (
            hooked.join(found, "label").select("node", "label", F.least("low", "found").alias("low")).join(jump, "low", "left")
            .select("node", F.least("low", F.coalesce("jump", "low")).alias("label"), F.col("label").alias("was"))
        )
        after = materialise(after, "labels")
        if after.where("label < was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")

"""Lineage graph operators on an edge table ``(consumer, producer)``
(L1-L4).

Graph walks are loops of DataFrame joins over waves of nodes.  Each round's
wave is written to the session's checkpoint directory
(``spark.checkpoint.dir`` on a cluster) and read back, which keeps plans
small and means a lost executor only recomputes the current round.  The
driver only learns whether a wave is empty.  The edges are written there too,
once for each end they are met by, in buckets of that end: a round moves nodes,
never edges.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablework.operators.ranges import Ranges
from tablework.session import checkpoint_dir


class CycleError(ValueError):
    """The dependency graph has a cycle."""


class GraphError(ValueError):
    """An edge is invalid (self reference, unknown producer)."""


def _cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint directory (reliable
    storage: a lost executor never forces a replay of earlier rounds)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# ---------------------------------------------------------------- L1
def build_edges(inputs: DataFrame, references: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Edges from declared inputs ``(consumer, producer)`` and cross-package
    references ``(consumer, producer)``; a self-input is an error, a
    same-package reference adds no edge; with ``nodes`` given, an unknown
    producer is an error.  Returns distinct edges."""
    bad = inputs.where(F.col("consumer") == F.col("producer")).limit(1).collect()
    if bad:
        raise GraphError(f"{bad[0]['consumer']!r} cannot reference itself")
    edges = inputs.select("consumer", "producer")
    if references is not None:
        edges = edges.unionByName(references.where(F.col("consumer") != F.col("producer")).select("consumer", "producer"))
    edges = edges.distinct()
    if nodes is not None:
        unknown = edges.join(nodes.select(F.col("node").alias("producer")), "producer", "left_anti").limit(1).collect()
        if unknown:
            raise GraphError(f"{unknown[0]['consumer']!r} references missing {unknown[0]['producer']!r}")
    return edges


def nodes_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    n = edges.select(F.col("consumer").alias("node")).unionByName(edges.select(F.col("producer").alias("node")))
    if nodes is not None:
        n = n.unionByName(nodes.select("node"))
    return n.distinct()


# ---------------------------------------------------------------- L2
def expand_lineage(edges: DataFrame, seeds: DataFrame | None, direction: str = "prod") -> DataFrame:
    """Selection expansion with hop distance.

    ``prod``: seeds plus everything downstream (consumers, transitively);
    ``preview``: the closure in both directions.  No seeds selects every
    node (depth 0).  Returns ``(node, depth)``, depth = fewest hops from a
    seed.

    The edges are stored by their source once; a round moves only the newest
    frontier.  What has been visited is appended to one table, so the plan of a
    round does not grow; the walk ends when a frontier is empty.
    """
    if direction not in _WAYS:
        raise ValueError("direction must be prod or preview")
    if seeds is None:
        return nodes_of(edges).withColumn("depth", F.lit(0))
    return _walk(_Edges(edges), seeds, _WAYS[direction])


_DOWN, _UP = ("producer", "consumer"), ("consumer", "producer")
_WAYS = {"prod": [_DOWN], "preview": [_DOWN, _UP]}


def _walk(edges: _Edges, seeds: DataFrame, ways: list[tuple[str, str]]) -> DataFrame:
    """``(node, depth)`` of what the seeds reach along ``ways`` (from, to)."""
    visited = _Waves(seeds.sparkSession, "depth")
    frontier = seeds.select(F.col("node")).distinct()
    depth = 0
    while True:
        frontier, empty = visited.add(frontier, depth)
        if empty:
            return visited.table()
        depth += 1
        ends = [frontier.join(edges.by(a), frontier["node"] == F.col(a)).select(F.col(b).alias("node")) for a, b in ways]
        reached = reduce(DataFrame.unionByName, ends).distinct()
        frontier = reached.join(visited.table().select("node"), "node", "left_anti")


EDGE_ROWS = 250_000  # edges in a bucket


class _Edges:
    """The distinct edges, stored in buckets of one end or of each, so that
    joins and counts on that end do not move them."""

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        self.edges = edges.select("consumer", "producer")
        self.buckets = max(1, -(-self.edges.count() // EDGE_ROWS))
        self.sides: dict[str, DataFrame] = {}

    def by(self, end: str) -> DataFrame:
        if end not in self.sides:
            stored = next(iter(self.sides.values()), None)
            dealt = self.edges.repartition(self.buckets, end).distinct() if stored is None else stored.repartition(self.buckets, end)
            self.sides[end] = self._store(dealt, end)
        return self.sides[end]

    def nodes(self, more: DataFrame | None = None) -> DataFrame:
        ends = [self.by(end).select(F.col(end).alias("node")).distinct() for end in _DOWN]
        return reduce(DataFrame.unionByName, ends + ([] if more is None else [more.select("node")])).distinct()

    def waits(self) -> DataFrame:
        """``(node, waits, leads)`` of every consumer: its number of
        dependencies, and whether anything depends on it."""
        counts = self.by("consumer").groupBy(F.col("consumer").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
        leading = self.by("producer").select(F.col("producer").alias("node")).distinct().withColumn("leads", F.lit(True))
        return self._store(counts.join(leading, "node", "left").withColumn("leads", F.coalesce("leads", F.lit(False))), "node")

    def _store(self, dealt: DataFrame, end: str) -> DataFrame:
        name = f"lineage_{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/{name}"
        dealt.write.format("parquet").bucketBy(self.buckets, end).sortBy(end).option("path", path).saveAsTable(name)
        stored = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only: the files are at a path of their own
        return stored


class _Waves:
    """Numbered waves of nodes, appended to one table in the shared folder."""

    def __init__(self, spark: SparkSession, number: str):
        self.spark, self.number = spark, number
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/waves-{uuid.uuid4().hex}"
        self.schema: StructType | None = None

    def add(self, nodes: DataFrame, wave: int, flag: str | None = None) -> tuple[DataFrame, bool]:
        """Write a wave; read back, and whether it (or what has ``flag``) is empty."""
        rows = nodes.withColumn(self.number, F.lit(wave))
        self.schema = self.schema or rows.schema
        rows.write.mode("append").parquet(f"{self.path}/{wave}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/{wave}")
        return written.drop(self.number), (written.where(flag) if flag else written).isEmpty()

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def ordered_selection(edges: DataFrame, seeds: DataFrame | None, direction: str = "prod") -> DataFrame:
    """L2 in producer-first order: ``(node, depth, rank)`` of the selection,
    ranked as in :func:`producer_first` of the whole graph.

    A node's place follows from its ancestors alone, so the waves run over the
    selection and what it depends on, not over the whole graph; a selection in
    both directions holds that already.  A cycle there raises
    :class:`CycleError`.
    """
    if direction not in _WAYS:
        raise ValueError("direction must be prod or preview")
    inner = _Edges(edges)
    if seeds is None:
        chosen = needed = inner.nodes().withColumn("depth", F.lit(0))
    else:
        chosen = needed = _walk(inner, seeds, _WAYS[direction])
        if _UP not in _WAYS[direction]:
            needed = _walk(inner, chosen, [_UP])
            inner = _Edges(inner.by("consumer").join(needed.select(F.col("node").alias("consumer")), "consumer", "left_semi"))
    keyed, remainder = _peel(inner, needed.select("node").distinct(), with_order=True)
    if not remainder.isEmpty():
        assert_acyclic(_inside(inner.by("consumer"), needed))
    ordered = keyed.select("node", "best").join(chosen, "node")
    return Ranges(ordered, [F.col("best").asc()], chosen.count()).numbered().select("node", "depth", "rank")


# ---------------------------------------------------------------- L3
def _peel(edges: _Edges, nodes: DataFrame, with_order: bool) -> tuple[DataFrame, DataFrame]:
    """``(node, level[, best])`` of those of ``nodes`` that can be ordered, and
    the remainder (cycles and what depends on them).  ``nodes`` are distinct
    and hold all that they depend on.

    A wave holds the nodes whose dependencies are all in earlier waves.  A
    round meets the consumers of those in the newest wave that anything depends
    on, and adds up, per consumer, the dependencies met so far.  Only consumers
    that were met and still wait are carried on; all others stay untouched in
    the table of dependency counts.

    ``best`` is a node's sort key: the largest key among its dependencies, less
    the names at its end that are smaller than the node's own, plus that name.
    In the order that always takes the smallest ready name, a node follows its
    last dependency, and what is ready and smaller than the name before comes
    at once; so key order is that order.  Along the edges a wave's keys go as
    their places among each other, a number each; only the largest of a
    consumer becomes a key again.
    """
    deps, waits = edges.by("producer"), edges.waits()
    own = F.concat(F.filter("best", lambda x: x > F.col("node")), F.array("node"))
    extra = ["best"] if with_order else []
    waves = _Waves(edges.spark, "level")
    zero = F.lit(0).cast("long")
    state = nodes.join(waits, "node", "left_anti").select("node", zero.alias("met"), zero.alias("waits"), F.lit(True).alias("leads"), *[F.array("node").alias(c) for c in extra], F.lit(True).alias("ready"))
    level = 0
    while True:
        state, empty = waves.add(state, level, "ready AND leads")
        if empty:
            break
        newest = state.where("ready AND leads").select("node", *extra)
        if with_order:
            newest = Ranges(newest, [F.col("best").asc()]).numbered("place")
        reached = newest.join(deps, newest["node"] == deps["producer"]).groupBy(F.col("consumer").alias("node"))
        met = reached.agg(F.count(F.lit(1)).alias("met"), *[F.max("place").alias("place") for _ in extra]).join(waits, "node")
        if with_order:
            met = met.join(newest.select("place", "best"), "place")
        columns = ["node", "met", "waits", "leads", *extra]
        waiting = state.where("NOT ready").select(*columns)
        met = met.select(*columns)
        if not waiting.isEmpty():
            met = met.unionByName(waiting).groupBy("node", "waits", "leads").agg(F.sum("met").alias("met"), *[F.max(c).alias(c) for c in extra])
        ready = F.col("met") == F.col("waits")
        state = met.select("node", "met", "waits", "leads", *[F.when(ready, own).otherwise(F.col(c)).alias(c) for c in extra], ready.alias("ready"))
        level += 1
    levels = waves.table().where("ready").select("node", "level", *extra)
    return levels, nodes.join(levels.select("node"), "node", "left_anti")


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Peel the graph: level 0 = nodes without dependencies, level k =
    nodes whose dependencies all have a level < k (so level = longest path
    from a source).  Returns ``(levels, remainder)`` where ``remainder``
    holds the nodes left when no node is ready (cycles and what depends on
    them); order a wave by name to get a producer-first order."""
    stored = _Edges(edges)
    return _peel(stored, stored.nodes(nodes), with_order=False)


def producer_first(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, level, rank)``: the smallest producer-first order, in which the
    next node is always the smallest name whose dependencies are all placed.

    Ranks come from range counts over the sort keys of :func:`_peel`; a key
    holds at most the names of one path.  A cycle raises :class:`CycleError`.
    """
    stored = _Edges(edges)
    keyed, remainder = _peel(stored, stored.nodes(nodes), with_order=True)
    if not remainder.isEmpty():
        assert_acyclic(edges)
    return Ranges(keyed, [F.col("best").asc()]).numbered().select("node", "level", "rank")


def ordered_levels(levels: DataFrame) -> DataFrame:
    return levels.orderBy(F.col("level").asc(), F.col("node").asc())


# ---------------------------------------------------------------- L4
def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    return edges.join(nodes.select(F.col("node").alias("consumer")), "consumer", "left_semi").join(nodes.select(F.col("node").alias("producer")), "producer", "left_semi")


def _spread(start: DataFrame, step: DataFrame) -> DataFrame:
    """(node, label) with the largest label that reaches a node along ``step``
    (src, dst), its own included."""
    labels = _cut(start)
    while True:
        near = labels.join(step, labels["node"] == step["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("near"))
        after = labels.join(near, "node", "left").select("node", F.greatest("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        after = _cut(after)
        if after.where("label > was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without dependencies and nodes without
    consumers are taken away until there are none: cycles and what lies
    between them.  A round keeps the edges whose consumer is still consumed
    and whose producer still depends; leaves go first, so what hangs off the
    cycles, mostly the bulk of the rows, leaves in the first rounds."""
    left = _cut(edges.select("consumer", "producer").distinct())
    n = left.count()
    while True:
        consumed = left.select(F.col("producer").alias("consumer")).distinct()
        depends = left.select(F.col("consumer").alias("producer")).distinct()
        left = _cut(left.join(consumed, "consumer", "left_semi").join(depends, "producer", "left_semi").select("consumer", "producer"))
        now = left.count()
        if now in (0, n):
            return left
        n = now


def cycle_parts(edges: DataFrame) -> DataFrame:
    """``(node, part)`` of the nodes that reach themselves; a node that only
    lies between two cycles is none.  ``part`` is the smallest node of the
    strongly connected part.

    Forward and backward reach inside the core: every node takes the largest
    name that reaches it; the nodes of one name that reach back to the node of
    that name are one part.  Parts found are taken out, and the core is trimmed
    again, until no edge is left.
    """
    inner = cyclic_core(edges)
    # a node that consumes itself is cyclic wherever it is found
    loops = inner.where("consumer = producer").select(F.col("consumer").alias("node")).distinct()
    found: DataFrame | None = None
    while not inner.isEmpty():
        rem = nodes_of(inner)
        colour = _spread(rem.select("node", F.col("node").alias("label")), inner.select(F.col("producer").alias("src"), F.col("consumer").alias("dst")))
        one = lambda c: colour.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        same = _cut(inner.join(one("consumer"), "consumer").join(one("producer"), "producer").where("consumer_label = producer_label").select("consumer", "producer"))
        # backwards from the node that gave the colour its name, within the colour
        start = colour.select("node", F.when(F.col("node") == F.col("label"), 1).otherwise(0).alias("label"))
        part = _spread(start, same.select(F.col("consumer").alias("src"), F.col("producer").alias("dst"))).where("label = 1")
        members = part.select("node").join(colour, "node")
        named = members.groupBy("label").agg(F.min("node").alias("part"), F.count(F.lit(1)).alias("n"))
        members = _cut(members.join(named, "label").join(loops.withColumn("loop", F.lit(True)), "node", "left").select("node", "part", ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic")))
        found = members if found is None else _cut(found.unionByName(members))
        for end in ("consumer", "producer"):
            inner = inner.join(members.select(F.col("node").alias(end)), end, "left_anti")
        inner = cyclic_core(inner)
    if found is None:
        return nodes_of(inner).withColumn("part", F.col("node"))
    return found.where("cyclic").select("node", "part")


def cycle_set(edges: DataFrame, remainder: DataFrame | None = None) -> DataFrame:
    """Nodes on a cycle, of ``remainder`` if given (all cycles lie in what
    :func:`topological_levels` leaves)."""
    return cycle_parts(edges if remainder is None else _inside(edges, remainder)).select("node")


def cycle_chains(edges: DataFrame) -> DataFrame:
    """``(part, hop, consumer, producer)``: one dependency chain
    ``a -> b -> ... -> a`` of every strongly connected part, a row per hop
    (from 0).

    From the smallest node of a part, always on to the smallest dependency
    inside the part, until a node comes again; the chain is what lies between.
    Positions are found by pointer doubling: after k rounds the first 2^k nodes
    of every walk are known, and a walk that repeats a node is finished.
    """
    parts = _cut(cycle_parts(edges))
    one = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    inside = edges.join(one("consumer"), "consumer").join(one("producer"), "producer").where("consumer_part = producer_part")
    jump = _cut(inside.groupBy(F.col("consumer").alias("node")).agg(F.min("producer").alias("to")))
    walk = _cut(parts.select("part").distinct().select("part", F.lit(0).cast("long").alias("at"), F.col("part").alias("node")))
    finished: DataFrame | None = None
    length = 1
    while not walk.isEmpty():
        further = walk.join(jump, "node").select("part", (F.col("at") + length).alias("at"), F.col("to").alias("node"))
        walk = _cut(walk.unionByName(further))
        # the first repeat of a walk ends its chain; a position earlier the node was seen first
        seen = Window.partitionBy("part", "node").orderBy("at")
        repeats = walk.withColumns({"n": F.row_number().over(seen), "first": F.min("at").over(seen)}).where("n = 2")
        ends = _cut(repeats.groupBy("part").agg(F.min(F.struct("at", "first")).alias("end")).select("part", F.col("end.at").alias("last"), F.col("end.first").alias("first")))
        chain = walk.join(ends, "part").where("at >= first AND at <= last").select("part", (F.col("at") - F.col("first")).alias("hop"), "node")
        finished = chain if finished is None else finished.unionByName(chain)
        walk = _cut(walk.join(ends, "part", "left_anti"))
        second = jump.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jump = _cut(jump.join(second, "to").select("node", F.col("far").alias("to")))
        length *= 2
    if finished is None:
        return edges.limit(0).select(F.col("consumer").alias("part"), F.lit(0).cast("long").alias("hop"), "consumer", "producer")
    finished = _cut(finished)
    back = finished.select("part", (F.col("hop") - 1).alias("hop"), F.col("node").alias("producer"))
    return finished.join(back, ["part", "hop"]).select("part", "hop", F.col("node").alias("consumer"), "producer")


def find_cycle(edges: DataFrame, nodes: DataFrame | None = None) -> list[str] | None:
    """One dependency chain ``a -> b -> ... -> a`` (of the part with the
    smallest node) or None; only the chain itself reaches the driver."""
    chains = cycle_chains(edges)
    smallest = chains.agg(F.min("part")).first()[0]
    if smallest is None:
        return None
    hops = chains.where(F.col("part") == smallest).orderBy("hop").collect()
    return [hops[0]["consumer"], *[h["producer"] for h in hops]]


def assert_acyclic(edges: DataFrame, nodes: DataFrame | None = None) -> None:
    chain = find_cycle(edges, nodes)
    if chain:
        raise CycleError("dependency cycle: " + " -> ".join(chain))


def graph_from_tables(spark: SparkSession, region: DataFrame, nation: DataFrame, customer: DataFrame, supplier: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Example lineage graph derived from the TPC-H style tables: a nation
    consumes its region, customers and suppliers consume their nation,
    orders consume their customer."""
    e = nation.select(
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("consumer"),
        F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("producer"),
    )
    e = e.unionByName(
        customer.select(
            F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("consumer"),
            F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("producer"),
        )
    ).unionByName(
        supplier.select(
            F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("consumer"),
            F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("producer"),
        )
    )
    if orders is not None:
        e = e.unionByName(
            orders.select(
                F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("consumer"),
                F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("producer"),
            )
        )
    return e


__all__ = [
    "CycleError",
    "GraphError",
    "assert_acyclic",
    "build_edges",
    "cycle_chains",
    "cycle_parts",
    "cycle_set",
    "cyclic_core",
    "expand_lineage",
    "find_cycle",
    "graph_from_tables",
    "nodes_of",
    "ordered_levels",
    "ordered_selection",
    "producer_first",
    "topological_levels",
]

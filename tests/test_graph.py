"""Lineage operators (FX6) and the path-prefix selection (FX11)."""

import random

import pytest

from tablework.operators import joins as jn
from tablework.operators import lineage as lg


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "consumer string, producer string")


def nodes(df):
    return sorted(r["node"] for r in df.collect())


def test_expansion_semantics(spark):
    edges = edges_df(spark, [("consumer", "producer")])
    seed = lambda n: spark.createDataFrame([(n,)], "node string")
    assert nodes(lg.expand_lineage(edges, seed("consumer"), "preview")) == ["consumer", "producer"]
    assert nodes(lg.expand_lineage(edges, seed("producer"), "preview")) == ["consumer", "producer"]
    assert nodes(lg.expand_lineage(edges, seed("producer"), "prod")) == ["consumer", "producer"]
    assert nodes(lg.expand_lineage(edges, seed("consumer"), "prod")) == ["consumer"]
    assert nodes(lg.expand_lineage(edges, None, "prod")) == ["consumer", "producer"]


def test_levels_producer_first(spark):
    edges = edges_df(spark, [("b", "a"), ("c", "b"), ("c", "a"), ("d", "a")])
    levels, remainder = lg.topological_levels(edges)
    got = [(r["level"], r["node"]) for r in lg.ordered_levels(levels).collect()]
    assert got == [(0, "a"), (1, "b"), (1, "d"), (2, "c")]
    assert remainder.count() == 0


def test_cycle_is_reported_with_chain(spark):
    edges = edges_df(spark, [("one", "two"), ("two", "one"), ("three", "one")])
    with pytest.raises(lg.CycleError, match=r"dependency cycle: (one -> two -> one|two -> one -> two)"):
        lg.assert_acyclic(edges)
    assert lg.find_cycle(edges_df(spark, [("b", "a")])) is None


def test_build_edges_rules(spark):
    inputs = edges_df(spark, [("c", "p")])
    refs = edges_df(spark, [("c", "c"), ("c", "q")])
    assert sorted(tuple(r) for r in lg.build_edges(inputs, refs).collect()) == [("c", "p"), ("c", "q")]
    with pytest.raises(lg.GraphError, match="itself"):
        lg.build_edges(edges_df(spark, [("x", "x")]))
    known = spark.createDataFrame([("c",), ("p",)], "node string")
    with pytest.raises(lg.GraphError, match="missing"):
        lg.build_edges(inputs, refs, nodes=known)


def test_changed_files_select_owners(spark):
    owners = spark.createDataFrame([("packages/first",), ("packages/second",)], "dir string")
    globals_ = ["schemas/", "src/"]

    def pick(paths, has_base=True):
        files = spark.createDataFrame([(p,) for p in paths], "path string")
        return sorted(r["dir"] for r in jn.selected_owners(files, owners, globals_, has_base=has_base).collect())

    assert pick(["packages/second/src/dive.tsx"]) == ["packages/second"]
    assert pick(["docs/readme.md"]) == []
    assert pick(["schemas/v1/package.schema.json"]) == ["packages/first", "packages/second"]
    assert pick(["packages/secondary/x"]) == []
    assert pick(["packages/first"]) == ["packages/first"]
    assert pick([], has_base=False) == ["packages/first", "packages/second"]
    assert pick([]) == []


def test_levels_of_a_chain_and_cycles_with_a_bridge(spark):
    chain = spark.createDataFrame([(f"n{i + 1:02d}", f"n{i:02d}") for i in range(25)], "consumer string, producer string")
    levels, rest = lg.topological_levels(chain)
    assert {r["node"]: r["level"] for r in levels.collect()} == {f"n{i:02d}": i for i in range(26)}
    assert rest.isEmpty()
    # a <-> b and x <-> y, with m between them: m is on no cycle
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("m", "a"), ("x", "m"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s")], "consumer string, producer string")
    _, rest = lg.topological_levels(edges)
    assert {r["node"] for r in lg.cycle_set(edges, rest).collect()} == {"a", "b", "x", "y", "s"}


def ready_list_order(pairs):
    """The order by hand: always the smallest name that is ready."""
    deps = {n: {p for c, p in pairs if c == n} for pair in pairs for n in pair}
    out = []
    while deps:
        name = min(n for n, d in deps.items() if not d)
        out.append(name)
        del deps[name]
        for d in deps.values():
            d.discard(name)
    return out


def random_dag(seed, n=40, m=70):
    rng = random.Random(seed)
    names = [f"{rng.choice('abcdefgh')}{i}" for i in range(n)]
    rng.shuffle(names)
    return sorted({(names[max(i, j)], names[min(i, j)]) for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if i != j})


def ranked(df):
    return [r["node"] for r in sorted(df.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("seed", range(2))
def test_producer_first_is_the_ready_list_order(spark, seed):
    pairs = random_dag(seed)
    want = ready_list_order(pairs)
    got = lg.producer_first(edges_df(spark, pairs))
    assert ranked(got) == want
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, len(want) + 1))
    levels = {r["node"]: r["level"] for r in got.collect()}
    assert want != sorted(want, key=lambda n: (levels[n], n))


def test_producer_first_with_single_nodes_and_cycles(spark):
    single = spark.createDataFrame([("zz",), ("a",)], "node string")
    assert ranked(lg.producer_first(edges_df(spark, [("b", "c"), ("b", "c"), ("a", "b")]), single)) == ["c", "b", "a", "zz"]
    with pytest.raises(lg.CycleError, match="a -> b -> a"):
        lg.producer_first(edges_df(spark, [("a", "b"), ("b", "a"), ("c", "a")]))


@pytest.mark.parametrize("direction", ["prod", "preview"])
def test_ordered_selection_keeps_the_order_of_the_whole_graph(spark, direction):
    pairs = random_dag(7) + [("lone2", "lone1")]
    seeds = [sorted(p for _, p in pairs)[3]]
    chosen, todo = set(seeds), list(seeds)
    while todo:
        n = todo.pop()
        for c, p in pairs:
            for a, b in [(p, c)] + ([(c, p)] if direction == "preview" else []):
                if a == n and b not in chosen:
                    chosen.add(b)
                    todo.append(b)
    got = lg.ordered_selection(edges_df(spark, pairs), spark.createDataFrame([(s,) for s in seeds], "node string"), direction)
    assert ranked(got) == [n for n in ready_list_order(pairs) if n in chosen]


def test_selection_orders_by_what_lies_outside_it_too(spark):
    # b waits for z, which is not selected
    edges = edges_df(spark, [("b", "z"), ("b", "s"), ("t", "s")])
    seeds = spark.createDataFrame([("s",)], "node string")
    assert ranked(lg.ordered_selection(edges, seeds, "prod")) == ["s", "t", "b"]


def test_rounds_do_not_move_the_edges(spark, monkeypatch):
    monkeypatch.setattr(lg, "EDGE_ROWS", 10)
    stored = lg._Edges(edges_df(spark, random_dag(3) * 2))
    assert stored.buckets > 4
    assert stored.by("producer").count() == len(random_dag(3))
    for end in ("producer", "consumer"):
        plan = stored.by(end).groupBy(end).count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    assert ranked(lg.producer_first(edges_df(spark, random_dag(3)))) == ready_list_order(random_dag(3))


def test_a_selection_in_both_directions_is_walked_once(spark, monkeypatch):
    walks = []
    walk = lg._walk
    monkeypatch.setattr(lg, "_walk", lambda edges, seeds, ways: walks.append(ways) or walk(edges, seeds, ways))
    edges = edges_df(spark, [("b", "a"), ("c", "b"), ("y", "x"), (None, "a"), ("c", None)])
    seeds = spark.createDataFrame([("b",)], "node string")
    # a dependency without a name is never placed, so c is not either
    assert ranked(lg.ordered_selection(edges, seeds, "preview")) == ["a", "b"]
    assert len(walks) == 1


def test_cycle_chains_of_all_parts(spark):
    ring = [(f"r{i:02d}", f"r{(i + 1) % 13:02d}") for i in range(13)]
    pairs = ring + [("a", "b"), ("b", "c"), ("c", "b"), ("c", "a"), ("s", "s"), ("m", "a"), ("r03", "m"), ("x", "r00"), ("a", "y")]
    rows = lg.cycle_chains(edges_df(spark, pairs)).collect()
    chains = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["hop"])):
        chains.setdefault(r["part"], []).append((r["consumer"], r["producer"]))
    assert chains == {"a": [("a", "b"), ("b", "c"), ("c", "a")], "r00": ring, "s": [("s", "s")]}
    assert lg.cycle_chains(edges_df(spark, [("b", "a")])).count() == 0
    # the walk from the smallest node need not come back to it: only the repeated part is the chain
    got = lg.cycle_chains(edges_df(spark, [("a", "d"), ("d", "b"), ("b", "c"), ("c", "b"), ("c", "a")]))
    assert sorted((r["hop"], r["consumer"], r["producer"]) for r in got.collect()) == [(0, "a", "d"), (1, "d", "b"), (2, "b", "c"), (3, "c", "a")]
    got = lg.cycle_chains(edges_df(spark, [("a", "d"), ("d", "b"), ("b", "bb"), ("bb", "b"), ("bb", "z"), ("z", "a")]))
    assert sorted((r["hop"], r["consumer"], r["producer"]) for r in got.collect()) == [(0, "b", "bb"), (1, "bb", "b")]

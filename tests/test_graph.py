"""Graph operators against plain searches on random graphs, long chains and cycles."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.functions.storage import table
from lattica.operators import graph


def pairs_of(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes):03}", f"n{rng.randrange(nodes):03}") for _ in range(edges)})


def plain_reach(pairs, names):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    out = {}
    for x in names:
        seen, todo = set(), list(near.get(x, ()))
        while todo:
            if (y := todo.pop()) not in seen:
                seen.add(y)
                todo += near.get(y, ())
        out[x] = seen
    return out


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("nodes,edges", [(150, 190), (200, 200)])
def test_reach_in_words_of_64(spark, nodes, edges):
    """More nodes than a word has bits; several components; condensed once for all measures."""
    pairs = [p for p in pairs_of(nodes, nodes, edges) if p[0] != p[1]]
    names = sorted({x for p in pairs for x in p})
    reach = plain_reach(pairs, names)
    e, n = frame(spark, pairs), spark.createDataFrame([(x,) for x in [*names, "alone"]], "node string")
    parts = graph.condense(e)
    assert {(r.start, r.node) for r in graph.closure(e).collect()} == {(x, y) for x in names for y in reach[x] if x != y}
    got = {r.node: (r.forward, r.reverse, r.scc_size) for r in graph.reach_counts(e, parts).collect()}
    size = {x: sum(y in reach[x] and x in reach[y] for y in names) for x in names}
    assert got == {x: (len(reach[x] - {x}), sum(x in reach[y] for y in names if y != x), size[x] if size[x] > 1 else 0) for x in names}
    values = [(x, k * 37 % 1000 if k % 7 else None, k % 2) for k, x in enumerate([*names, "alone"]) if k % 5]
    own = {x: (v or 0, o) for x, v, o in values}
    sums = graph.reach_sums(e, spark.createDataFrame(values, "node string, v int, o int"), parts)
    assert {r.node: (r.v, r.o) for r in sums.collect()} == {x: tuple(sum(own.get(y, (0, 0))[c] for y in reach.get(x, set()) | {x}) for c in (0, 1)) for x in own}

    def longest(x):
        return max((1 + longest(b) for a, b in pairs if a == x), default=0)

    cyclic = {x for x in names if x in reach[x]}
    want = {x: nodes_ if cyclic & (reach.get(x, set()) | {x}) else longest(x) for nodes_ in (len(names) + 1,) for x in [*names, "alone"]}
    assert {r.node: r.depth for r in graph.depths(e, n, parts).collect()} == want


def test_components_use_every_core(spark):
    """No graph goes through one task whole: what the local step deals is as wide as the session."""
    pairs = [(f"n{k:03}", f"n{(k + 1) % 200:03}") for k in range(200)] + [("x", "n000"), ("n100", "y")]
    e = frame(spark, pairs)
    n = spark.createDataFrame([(x,) for x in sorted({y for p in pairs for y in p})], "node string")
    got = {r.node: r.component for r in graph.components(e, n).collect()}
    assert got == {f"n{k:03}": "n000" for k in range(200)} | {"x": "x", "y": "y"}
    assert spark.sparkContext.defaultParallelism > 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_random_graphs(spark, seed):
    pairs = pairs_of(seed, 60, 60 + 20 * seed)
    names = sorted({x for p in pairs for x in p})
    reach = plain_reach(pairs, names)
    want = {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in names}
    got = graph.components(frame(spark, pairs), spark.createDataFrame([(x,) for x in names], "node string"))
    assert {r.node: r.component for r in got.collect()} == want


def test_levels_of_a_long_chain_double(spark, monkeypatch):
    """A hundred thousand parents in a row take about 17 rounds, not a hundred thousand."""
    tables = []
    real = graph.table
    monkeypatch.setattr(graph, "table", lambda df, name: tables.append(name) or real(df, name))
    n = 100_000
    chain = spark.range(n).selectExpr("cast(id as string) as node", "case when id > 0 then cast(id - 1 as string) end as parent")
    wrong = graph.tree_levels(chain).where("level <> cast(node as long)").count()
    assert wrong == 0 and len(tables) <= 20


def test_levels_with_seeds_and_cycles(spark):
    rows = [("a", None, 0), ("b", "a", 3), ("c", "b", 0), ("d", "c", 9), ("e", "gone", 1)]
    nodes = spark.createDataFrame(rows, "node string, parent string, seed int")
    want = {"a": 0, "b": 3, "c": 4, "d": 9, "e": 1}
    assert {r.node: r.level for r in graph.tree_levels(nodes).collect()} == want
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")])
    assert {r.node: r.level for r in graph.levels(e, nodes).collect()} == want
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "node string, parent string")
    with pytest.raises(ValueError):
        graph.tree_levels(ring)
    with pytest.raises(ValueError):
        graph.levels(frame(spark, [("a", "b"), ("b", "a")]), ring)


def test_ancestors_and_containers(spark):
    """A chain, a cycle with a tail, and roots in between; a plain chase with a set of seen nodes says the same."""
    parent = {f"t{k}": f"t{k - 1}" for k in range(1, 40)} | {"c0": "c1", "c1": "c2", "c2": "c0", "u": "c1", "v": "u", "self": "self"}
    kinds = {"t0": "ROOT", "t20": "ROOT"}
    names = sorted({*parent, *parent.values()})
    nodes = spark.createDataFrame([(x, parent.get(x), kinds.get(x, "CLASS")) for x in names], "node string, parent string, node_type string")

    def chase(x):
        out, seen, at = [], {x}, x
        while (at := parent.get(at)) and at not in seen:
            seen.add(at)
            out.append(at)
        return out

    for limit in (None, 1, 3, 8):
        got = {(r.node, r.ancestor): r.distance for r in graph.ancestors(nodes, limit).collect()}
        assert got == {(x, a): k + 1 for x in names for k, a in enumerate(chase(x)[:limit])}

    def climb(x):
        at, best, seen = x, x, set()
        while x not in kinds and at in parent and at not in seen:
            seen.add(at)
            if parent[at] in kinds:
                break
            at = best = parent[at]
        return best

    assert {r.node: r.cluster for r in graph.top_container(nodes, ["ROOT"]).collect()} == {x: climb(x) for x in names}


def test_empty_graphs(spark):
    e, n = frame(spark, []), spark.createDataFrame([("a",)], "node string")
    assert graph.closure(e).count() == graph.reach_counts(e).count() == 0
    assert [tuple(r) for r in graph.components(e, n).collect()] == [("a", "a")]
    assert [tuple(r) for r in graph.depths(e, n).collect()] == [("a", 0)]
    loop = frame(spark, [("a", "a")])
    assert [tuple(r) for r in graph.components(loop, n).collect()] == [("a", "a")]


def _shuffled_rings(spark, rings, size):
    """Rings of nodes whose names say nothing of the ring."""
    name = lambda r, k: f"m:{(k * rings + r) * 7919 % 100003}"
    return spark.createDataFrame([(name(r, k), name(r, (k + 1) % size)) for r in range(rings) for k in range(size)], "src string, dst string")


def test_places_of_a_component_share_blocks(spark):
    e = _shuffled_rings(spark, 40, 30)
    place = graph._placed(e.selectExpr("src as node").distinct(), e, "node")
    words = graph.spread_bits(e, graph._words(place, "node"))
    assert words.count() < 36_000 // 5  # pairs
    assert graph.closure(e).count() == 40 * 30 * 29


def test_closure_deals_pairs_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "LARGE", 10)
    ring = lambda name, n: [(f"{name}{k}", f"{name}{(k + 1) % n}") for k in range(n)]
    e = spark.createDataFrame([*ring("a", 60), *ring("b", 30), ("a7", "b3"), ("x", "a0"), ("b9", "y"), *ring("c", 3)], "src string, dst string")
    rows = graph.closure(e).withColumn("task", F.spark_partition_id()).collect()
    a, b, c = ([f"{name}{k}" for k in range(n)] for name, n in (("a", 60), ("b", 30), ("c", 3)))
    want = {(s, t) for s in ["x", *a] for t in [*a, *b, "y"]} | {(s, t) for s in b for t in [*b, "y"]} | {(s, t) for s in c for t in c}
    assert sorted((r["start"], r["node"]) for r in rows) == sorted((s, t) for s, t in want if s != t)
    tasks = Counter(r["task"] for r in rows)
    assert max(tasks.values()) < len(rows) / 2  # the pairs of a component with itself came from one task


def test_closure_puts_out_pairs_after_the_last_join(spark, monkeypatch):
    """Pairs of nodes were made by a join on the component alone, sorted in one task; now lists meet and are put out last."""
    monkeypatch.setattr(graph, "LARGE", 10)
    e = spark.createDataFrame([(f"a{k}", f"a{(k + 1) % 60}") for k in range(60)], "src string, dst string")
    df = graph.closure(e)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(lefts") < plan.index("Join") and plan.index("Generate explode(rights") < plan.index("Join")
    assert df.count() == 60 * 59


def test_representative_paths_write_words_and_one_path_a_start(spark, monkeypatch):
    e, wrote = _shuffled_rings(spark, 20, 12), []

    def counted(df, name):
        out = table(df, name)
        wrote.append((out.count(), "path" in out.columns))
        return out

    monkeypatch.setattr(graph, "table", counted)
    got = {r["start"]: r["path"] for r in graph.representative_paths(e, e.selectExpr("src as start")).collect()}
    to = {r["src"]: r["dst"] for r in e.collect()}
    for start, path in got.items():
        assert path[0] == start and len(path) == 12 and all(to[a] == b for a, b in zip(path, path[1:]))
    assert len(got) == 240 and max(n for n, paths in wrote if paths) == 240


@pytest.mark.parametrize("whole", [0, 500_000])
def test_representative_paths_of_a_connected_graph(spark, monkeypatch, whole):
    """Depths of all pairs were written whatever the graph; a small one is gone through inside tasks, with the same paths."""
    monkeypatch.setattr(graph, "WHOLE", whole)
    rng, wrote = random.Random(4), []
    monkeypatch.setattr(graph, "table", lambda df, name: wrote.append(name) or table(df, name))
    pairs = sorted({(f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for _ in range(110)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    want = {}
    for start in [*near, "alone"]:
        seen, front, best = {start}, {start: (start,)}, (start,)
        while front and len(best) < 6:
            step = {}
            for node, path in front.items():
                for b in near.get(node, ()):
                    if b not in seen:
                        step[b] = min(step.get(b, path + (b,)), path + (b,))
            seen |= set(step)
            front, best = step, min(step.values()) if step else best
        want[start] = best
    starts = spark.createDataFrame([(s,) for s in want], "start string")
    got = graph.representative_paths(spark.createDataFrame(pairs, "src string, dst string"), starts, 6)
    assert {r["start"]: tuple(r["path"]) for r in got.collect()} == want
    assert not whole or wrote == ["edges", "chain"]


def test_chain_crossings_write_no_depths_of_pairs(spark, monkeypatch):
    from lattica.plans import graph_queries

    wrote = []
    monkeypatch.setattr(graph, "table", lambda df, name: wrote.append(name) or table(df, name))
    assert graph_queries.QUERIES["chain_crossings"](spark, "/root/testdata/sf0.001").count() > 0
    assert wrote == ["edges", "chain"]  # were levels and marks of all pairs too


def test_representative_paths_with_ties_and_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "e"), ("c", "d"), ("d", "a"), ("e", "e"), ("c", "c"), ("x", "a")], "src string, dst string")
    starts = spark.createDataFrame([(x,) for x in "aexz"], "start string")
    got = {r["start"]: r["path"] for r in graph.representative_paths(e, starts).collect()}
    assert got == {"a": ["a", "b", "e"], "e": ["e"], "x": ["x", "a", "b", "e"], "z": ["z"]}
    assert {r["start"]: r["path"] for r in graph.representative_paths(e, starts, 2).collect()} == {"a": ["a", "b"], "e": ["e"], "x": ["x", "a"], "z": ["z"]}


def test_chain_crossings_hold_one_path_a_start(spark):
    e = _shuffled_rings(spark, 10, 9)
    owner = e.selectExpr("src as node", "cast(substr(src, 3) as int) % 2 as owner")
    chains = graph.representative_paths(e, e.selectExpr("src as start"))
    own = {r["node"]: r["owner"] for r in owner.collect()}
    want = {r["start"]: sum(own[a] != own[b] for a, b in zip(r["path"], r["path"][1:])) for r in chains.collect()}
    assert {r["start"]: r["crossings"] for r in graph.crossings(chains, owner).collect()} == want and len(want) == 90

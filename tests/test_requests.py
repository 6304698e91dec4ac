"""Requests out of bounds, unknown ids, and answers on a small atlas."""

import pytest

from lattica.operators import requests as rq

NODES = "node string, name string, qualified_name string, node_type string, path string, start_line int, end_line int, is_public boolean"


@pytest.fixture(scope="module")
def atlas(spark):
    nodes = [
        ("r", "shop", "shop", "REPOSITORY", "", None, None, True),
        ("a", "a", "shop.a", "MODULE", "a.py", 1, 9, True),
        ("b", "b", "shop.b", "MODULE", "b.py", 2, None, None),
        ("c", "c", "shop.c", "CLASS", "a.py", 3, 5, False),
        ("t", "t", "tests.t", "TEST_MODULE", "t.py", 1, 2, True),
    ]
    edges = [("1", "a", "b", "IMPORTS"), ("2", "b", "c", "CALLS"), ("0", "b", "c", "IMPORTS"), ("3", "t", "c", "TESTS"), ("4", "r", "a", "CONTAINS"), ("5", "a", "c", "CONTAINS"), ("6", "c", "gone", "CALLS"), ("7", "c", "a", "CALLS")]
    metrics = [("a", "dependency.fan_in", 3.0), ("b", "dependency.fan_in", 3.0), ("c", "local.fan_in", 9.0), ("a", "dependency.cycle_size", 1.0)]
    files = [("a.py", "".join(f"line {k}\n" for k in range(1, 12))), ("t.py", "one")]
    return rq.Atlas(
        spark.createDataFrame(nodes, NODES),
        spark.createDataFrame(edges, "edge_id string, src string, dst string, edge_type string"),
        spark.createDataFrame(metrics, "node string, metric string, value double"),
        spark.createDataFrame([(1, "c", "X"), (2, "gone", "x"), (3, "a", "y")], "position long, node string, code string"),
        spark.createDataFrame(files, "path string, source string"),
    )


@pytest.mark.parametrize(
    "raw",
    [
        {},
        {"kind": "select"},
        {"kind": "repository_summary", "limit": 0},
        {"kind": "repository_summary", "limit": 101},
        {"kind": "repository_summary", "limit": True},
        {"kind": "repository_summary", "limit": "5"},
        {"kind": "repository_summary", "depth": 1},
        {"kind": "subsystem_summary"},
        {"kind": "node_details", "node": 5},
        {"kind": "forward_neighbourhood", "node": "a", "depth": 6},
        {"kind": "shortest_dependency_path", "source": "a"},
        {"kind": "signals", "codes": ["x"] * 11},
        {"kind": "signals", "codes": "x"},
        {"kind": "search_nodes", "terms": []},
        {"kind": "search_nodes", "terms": [1]},
        {"kind": "source_excerpt", "node": "a", "context": 21},
        {"kind": "source_excerpt", "node": "a", "lines": 201},
        {"kind": "review_context"},
        {"kind": "review_context", "nodes": ["x"] * 41},
    ],
)
def test_requests_out_of_bounds(raw):
    with pytest.raises(rq.RequestError):
        rq.parse(raw)


def test_every_kind_is_parsed():
    more = {rq.Relation: {"node": "a"}, rq.Neighbourhood: {"node": "a"}, rq.Subsystem: {"node": "a"}, rq.Details: {"node": "a"}, rq.Excerpt: {"node": "a"}, rq.Path: {"source": "a", "target": "b"}, rq.Hotspots: {"metric": "m"}, rq.Search: {"terms": ["x"]}, rq.Context: {"names": ["x"]}}
    for kind, shape in rq.SHAPES.items():
        assert type(rq.parse({"kind": kind} | more.get(shape, {}))) is shape
    assert len(rq.SHAPES) == 17 and len(set(rq.SHAPES.values())) == 12 == len(rq.ANSWERS)


@pytest.mark.parametrize(
    "raw",
    [
        {"kind": "node_details", "node": "gone"},
        {"kind": "subsystem_summary", "node": "gone"},
        {"kind": "known_callers", "node": "gone"},
        {"kind": "reverse_neighbourhood", "node": "gone"},
        {"kind": "shortest_dependency_path", "source": "a", "target": "gone"},
        {"kind": "hotspots", "metric": "local.lines"},
        {"kind": "source_excerpt", "node": "b"},
        {"kind": "source_excerpt", "node": "r"},
    ],
)
def test_requests_about_what_is_not_there(atlas, raw):
    with pytest.raises(rq.RequestError):
        rq.run(atlas, raw)


def ids(answer):
    return [r.node for r in answer.nodes.orderBy("position").collect()]


def test_answers(atlas):
    ask = lambda kind, **more: rq.run(atlas, {"kind": kind} | more)
    summary = ask("repository_summary", limit=2)
    assert ids(summary) == ["r", "a"] and tuple(summary.matched.first()) == (2, True, 5, 8, 3)
    assert [r.edge_id for r in summary.edges.collect()] == ["4"]
    path = ask("shortest_dependency_path", source="a", target="c")
    assert ids(path) == ["a", "b", "c"] and sorted((r.src, r.edge_id) for r in path.edges.collect()) == [("a", "1"), ("b", "0")]
    assert ids(ask("shortest_dependency_path", source="a", target="a")) == ["a"]
    none = ask("shortest_dependency_path", source="a", target="r")
    assert ids(none) == [] and none.matched.first().n == 0
    assert ids(ask("direct_dependencies", node="b")) == ["c"]
    callers = ask("known_callers", node="a", limit=1)
    assert ids(callers) == ["c"] and not callers.matched.first().truncated
    assert [r.node for r in ask("related_tests", node="c").tests.collect()] == ["t"]
    hot = ask("hotspots", metric="fan-in")  # the first group that has it is local
    assert [(r.node, r.metric, r.value, r.rank) for r in hot.metrics.collect()] == [("c", "local.fan_in", 9.0, 1)]
    assert ids(ask("hotspots", metric="dependency.fan_in")) == ["a", "b"]
    assert ids(ask("cyclic_components")) == []
    found = ask("signals", codes=["X"])
    assert ids(found) == ["c"] and found.signals.count() == 2
    assert ids(ask("signals", limit=1)) == ["c"] and ask("signals", limit=1).matched.first().truncated
    hits = ask("search_nodes", terms=["SHOP", ".PY"], limit=1)
    assert ids(hits) == ["a"] and tuple(hits.matched.first()) == (3, True)
    detail = {r.node: r.location for r in ask("search_nodes", terms=["shop"]).nodes.collect()}
    assert detail["b"] is None and tuple(detail["a"]) == ("a.py", 1, 9)
    near = ask("forward_neighbourhood", node="a", depth=2, limit=1)
    assert ids(near) == ["b"] and near.matched.first().truncated


def test_excerpts(spark, atlas):
    lines = rq.run(atlas, {"kind": "source_excerpt", "node": "c", "context": 1, "lines": 4}).excerpts.orderBy("line").collect()
    assert [r.text for r in lines] == [f"{k:5} | line {k}" for k in (2, 3, 4, 5)]
    known = {"parser_version": "1", "config": None, "repository": "x", "content": "y"}
    assert rq.stale(known, known | {"parser_version": None, "config": None}) == ""
    assert rq.stale(known, {"parser_version": "2", "config": "z", "repository": "x", "content": None}) == "parser_version and config and content"
    with pytest.raises(rq.RequestError):
        rq.run(atlas._replace(recorded=known, current=known | {"content": "z"}), {"kind": "source_excerpt", "node": "c"})
    for path in ("/a.py", "../a.py", "x/../../a.py", "a\\b", "none.py"):
        with pytest.raises(rq.RequestError):
            rq.source_lines(atlas.files, path, 1, 2)


def test_context_is_greedy_and_tolerant(spark):
    e = spark.createDataFrame([("1", "a", "x", "CALLS"), ("2", "a", "y", "CALLS"), ("3", "b", "x", "CALLS"), ("4", "b", "z", "CALLS"), ("5", "a", "b", "CALLS"), ("0", "a", "lost", "CALLS")], "edge_id string, src string, dst string, edge_type string")
    nodes = spark.createDataFrame([(n, n, f"q.{n}", "MODULE", n, None, None, None) for n in "abxyz"], NODES)
    answer = rq.run(rq.Atlas(nodes, e), {"kind": "review_context", "nodes": ["a", "none", "a"], "names": ["q.b", "q.none"], "limit": 1})
    assert ids(answer) == ["a", "b", "x", "z"] and answer.matched.first().asDict() == {"n": 2, "truncated": False, "asked": 3, "in_context": 4}
    assert {r.edge_id for r in answer.edges.collect()} == {"1", "3", "4", "5"}
    assert ids(rq.run(rq.Atlas(nodes, e), {"kind": "review_context", "nodes": ["none"]})) == []


def test_plans_are_checked_before_they_run(atlas):
    answers = rq.run_plan(atlas, [{"kind": "node_details", "node": "a"}, rq.Search("search_nodes", ["b"])])
    assert [ids(a) for a in answers] == [["a"], ["b"]]
    with pytest.raises(rq.RequestError):
        rq.run_plan(atlas, [{"kind": "signals"}] * 21)
    with pytest.raises(rq.RequestError):
        rq.run_plan(atlas, [{"kind": "node_details", "node": "a"}, {"kind": "nothing"}])

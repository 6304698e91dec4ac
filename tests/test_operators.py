"""Operators on small hand-built tables: edges of thresholds, ties, nulls, cycles."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions.columns import name_tokens, slug, stable_id
from lattica.operators import atlas, delta, detectors, graph, records, retrieval, structure
from lattica.sources import python_code as code


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_start_is_not_in_its_own_reach(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    got = {(r.start, r.node) for r in graph.closure(e).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd" if x != y}


def test_components_and_depths(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "f"), ("d", "f")])
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    assert {r.node: r.component for r in graph.components(e, nodes).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f", "g": "g"}
    assert {r.node: r.depth for r in graph.depths(e, nodes).collect()} == {"a": 7, "b": 7, "c": 7, "d": 2, "e": 1, "f": 0, "g": 0}


def test_shortest_path_takes_the_smallest_of_equal_ones(spark):
    e = edges(spark, [("a", "x"), ("a", "c"), ("x", "z"), ("c", "z"), ("a", "b"), ("b", "y"), ("y", "z")])
    assert [r.node for r in graph.shortest_path(e, "a", "z").orderBy("position").collect()] == ["a", "c", "z"]
    assert [r.node for r in graph.shortest_path(e, "a", "a").collect()] == ["a"]
    assert graph.shortest_path(e, "z", "a").count() == 0


def test_random_closure_against_plain_search(spark):
    rng = random.Random(5)
    pairs = {(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(20)}
    pairs = [(a, b) for a, b in pairs if a != b]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    want = set()
    for a in near:
        seen, todo = set(), [a]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        want |= {(a, y) for y in seen if y != a}
    assert {(r.start, r.node) for r in graph.closure(edges(spark, pairs)).collect()} == want


def test_review_context_is_greedy_over_anchors(spark):
    e = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3"), ("b", "z", "4"), ("a", "b", "5")], "src string, dst string, edge_id string")
    got = {(r.anchor, r.node) for r in atlas.review_context(e, ["a", "b", "a"], 1).collect()}
    assert got == {("a", "x"), ("a", "b"), ("b", "x"), ("b", "a"), ("b", "z")}


def test_ties_survive_only_where_they_should(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c")], "k int, at int, v string")
    assert records.latest(rows, ["k"], F.col("at").desc(), F.col("v")).first().v == "a"
    assert records.latest_with_ties(rows, ["k"], F.col("at").desc()).count() == 2


def test_two_candidates_may_claim_one_predecessor(spark):
    snap = "candidate int, signature string, content string, evidence string"
    cur = spark.createDataFrame([(1, "s", "c", "e"), (2, "s", "c", "e"), (3, "t", "c", "e2"), (5, "u", "c", "e")], snap)
    prev = spark.createDataFrame([(9, "s", "c", "e"), (3, "t", "c", "e"), (4, "v", "c", "e")], snap)
    older = spark.createDataFrame([(5,)], "candidate int")
    got = {r.candidate: (r.state, r.causes, r.predecessor) for r in delta.snapshot_delta(cur, prev, older, {}).collect()}
    assert got == {1: ("changed", "SHAPE", 9), 2: ("changed", "SHAPE", 9), 3: ("changed", "CONTENT", None), 4: ("addressed", "", None), 5: ("changed", "RESURFACED", None)}


def test_agreement_needs_a_literal(spark):
    c = spark.createDataFrame([("m1", "A", "x"), ("m2", "A", "x"), ("m1", "B", ""), ("m2", "B", ""), ("m1", "C", "x"), ("m1", "C", "y")], "module string, name string, fingerprint string")
    got = {r.name: (r.distinct_values, r.agreed) for r in detectors.duplicated_knowledge(c).collect()}
    assert got == {"A": (1, True), "B": (0, False)}


def test_unknown_scope_is_false(spark):
    p = spark.createDataFrame([("general", None), ("user", "ada"), ("user", None), ("adr", "shop")], "scope string, applies_to string")
    assert [r.a for r in p.select(retrieval.applies("ada", None, "shop").alias("a")).collect()] == [True, True, False, True]


def test_columns(spark):
    row = spark.createDataFrame([("parseHTTPResponse2xx_ok", "A b--C!")], "n string, t string").select(name_tokens(F.col("n")).alias("n"), slug(F.col("t")).alias("s"), stable_id("x", F.lit(None), F.lit("b")).alias("i")).first()
    assert row.n == ["parse", "http", "response", "2", "xx", "ok"] and row.s == "a-b-c" and len(row.i) == 26


def test_heading_chunks(spark):
    d = spark.createDataFrame([(1, "intro\n## A\nx\n## B\n  \n")], "k int, text string")
    assert [(r.position, r.text) for r in retrieval.heading_chunks(d, "k", "text", F.lit("T")).orderBy("position").collect()] == [(1, "T\n\nintro"), (2, "T\n\n## A\nx"), (3, "T\n\n## B")]


def test_parse_and_resolve(spark):
    files = spark.createDataFrame(
        [
            ("pkg/ports.py", "from typing import Protocol\nLIMIT = 3\nclass Store(Protocol):\n    def put(self, x): ...\n"),
            ("pkg/disk.py", "from pkg.ports import Store\nimport pkg.util\nLIMIT = 3\nclass Disk(Store):\n    def put(self, x):\n        return pkg.util.clean(x)\n"),
            ("pkg/util.py", "def clean(x):\n    return x\n"),
            ("broken.py", "def ("),
        ],
        "path string, source string",
    )
    rows = code.parse(files)
    assert {(r.src, r.dst) for r in code.import_edges(rows).collect()} == {("pkg.disk", "pkg.ports"), ("pkg.disk", "pkg.util")}
    assert {(r.src, r.dst, r.edge_type) for r in code.inherit_edges(rows).collect()} == {("pkg.disk.Disk", "pkg.ports.Store", "INHERITS"), ("pkg.disk.Disk", "pkg.ports.Store", "IMPLEMENTS")}
    assert {(r.src, r.dst) for r in code.call_edges(rows).collect()} == {("pkg.disk.Disk.put", "pkg.util.clean")}
    assert rows.where("kind = 'signal'").first().path == "broken.py"
    assert code.excerpt(files, "pkg/util.py", 1, 1, 1).orderBy("line").first().text == "    1 | def clean(x):"


def test_names_resolve_as_written_or_by_alias(spark):
    files = [
        ("pkg/a.py", "import sub.deep\nfrom pkg import b as other\nfrom . import c\n\nclass Base: ...\n\ndef only_here(): ...\n\nif True:\n    import pkg.late\n"),
        ("pkg/b.py", "from lib import only_here\nfrom pkg.a import Base as B\n\ndef f(x: only_here = only_here()):\n    import pkg.late\n    return [only_here for y in x] or (lambda z: only_here(z))\n\nclass C(B, Mixed):\n    made = only_here()\n    def g(self):\n        return self.h(), self.missing()\n    def h(self): ...\n"),
        ("pkg/c.py", "class Mixed: ...\nclass Twice: ...\n"),
        ("pkg/late.py", "class Twice: ...\nclass D(Twice): ...\nclass E(c.Twice): ...\n"),
        ("sub/deep/z.py", "X = 1\n"),
        ("sub/deep/y.py", "Y = [1]\nY2 = call()\n"),
    ]
    rows = code.parse(spark.createDataFrame(files, "path string, source string"))
    # the first module below a folder; what a body imports later is no dependency
    assert {(r.src, r.dst) for r in code.import_edges(rows).collect()} == {("pkg.a", "sub.deep.y"), ("pkg.b", "pkg.a")}
    calls = {(r.src, r.dst, r.confidence) for r in code.call_edges(rows).collect()}
    assert calls == {("pkg.b.f", "pkg.a.only_here", 0.7), ("pkg.b.C", "pkg.a.only_here", 0.7), ("pkg.b.C.g", "pkg.b.C.h", 1.0)}
    assert {(r.src, r.dst) for r in code.reference_edges(rows).collect()} == {("pkg.b.f", "pkg.a.only_here"), ("pkg.b.C", "pkg.a.only_here")}
    bases = {(r.src, r.dst) for r in code.inherit_edges(rows).collect()}
    assert bases == {("pkg.b.C", "pkg.a.Base"), ("pkg.b.C", "pkg.c.Mixed"), ("pkg.late.D", "pkg.late.Twice"), ("pkg.late.E", "pkg.c.Twice")}
    constants = {(r.module, r.name, r.fingerprint) for r in code.constants(rows).collect()}
    assert {c[:2] for c in constants} == {("sub.deep.z", "X"), ("sub.deep.y", "Y"), ("sub.deep.y", "Y2")} and ("sub.deep.y", "Y2", "") in constants


def test_last_edge_wins(spark):
    e = spark.createDataFrame([("x", 1, 1.0), ("x", 3, 0.7), ("x", 2, 1.0), ("y", 1, None)], "edge_id string, emit_seq int, confidence double")
    assert {(r.edge_id, r.emit_seq, r.confidence) for r in code.last_edge(e).collect()} == {("x", 3, 0.7), ("y", 1, None)}


def test_scan_reads_a_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"A = 1 # \xff\n")
    (tmp_path / ".venv").mkdir()
    (tmp_path / ".venv" / "y.py").write_text("B = 1")
    got = code.scan(spark, str(tmp_path)).collect()
    assert [(r.path, r.source) for r in got] == [("a/x.py", "A = 1 # �\n")]


def test_eviction_keeps_room_for_kept_files(spark):
    f = spark.createDataFrame([(1, 40), (2, 40), (3, 40)], "at int, size int")
    assert [r.at for r in records.eviction(f, "size", "at", 10, 100, F.col("at") == 1).collect()] == [2]


def test_running_total_over_parts(spark):
    rows = spark.createDataFrame([(k // 3, k, k % 5) for k in range(200)], "at int, id int, size int")
    got = {r.id: r.before for r in records.running_total(rows, "size", "at", ["id"], "before", 8).collect()}
    assert got == {k: sum(x % 5 for x in range(k)) for k in range(200)}


def test_components_in_many_tasks(spark, monkeypatch):
    """Cycles across tasks and cycles of cycles, against plain reachability."""
    import random

    monkeypatch.setattr(graph, "LOCAL", 12)
    rng = random.Random(6)
    pairs = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(52)} | {(f"m{k:02}", f"m{(k + 1) % 15:02}") for k in range(15)}
    e = spark.createDataFrame(sorted(pairs), "src string, dst string")
    names = sorted({x for p in pairs for x in p} | {"alone"})
    reach = {x: set() for x in names}
    for x in names:
        todo = [b for a, b in pairs if a == x]
        while todo:
            if (y := todo.pop()) not in reach[x]:
                reach[x].add(y)
                todo += [b for a, b in pairs if a == y]
    want = {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in names}
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    assert {r.node: r.component for r in graph.components(e, nodes).collect()} == want
    got = {r.node: (r.forward, r.reverse) for r in graph.reach_counts(e).collect()}
    assert all(got[x] == (len(reach[x] - {x}), sum(x in reach[y] for y in names if y != x)) for x in got) and len(got) == len(names) - 1
    value = {x: k * k % 17 if k % 5 else None for k, x in enumerate(names)}
    sums = graph.reach_sums(e, spark.createDataFrame([(x, value[x], 1) for x in names], "node string, v long, one int"))
    assert {r.node: (r.v, r.one) for r in sums.collect()} == {x: (sum(value[y] or 0 for y in reach[x] | {x}), len(reach[x] | {x})) for x in names}


def test_metric_profile_of_small_graph(spark):
    """a and b on a cycle, c imports a, the test t calls c; d has no edge, its test mark is unknown."""
    modules = spark.createDataFrame([("a", False), ("b", False), ("c", False), ("t", True), ("d", None)], "node string, is_test boolean")
    deps = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    calls = spark.createDataFrame([("t", "c")], "src string, dst string")
    targets = spark.createDataFrame([("c", "c.f"), ("c", "c.f"), ("c", "c.g"), ("d", "d.f")], "node string, target string")
    links = spark.createDataFrame([("t", "c", "TESTS"), ("t", "c", "TESTS"), ("c", "a", "IMPLEMENTS"), ("d", "a", "CONFIGURES")], "src string, dst string, edge_type string")
    names = "fan_in fan_out forward_reach reverse_reach neighbourhood scc_size depth affected affected_tests crossed_interfaces callers implementors tests configurations".split()
    got = {r.node: dict(zip(names, (r[c] for c in names))) for r in atlas.metric_profile(modules, deps, calls, targets, links).collect()}
    a = dict(zip(names, (2, 1, 1, 2, 2, 2, 5, 3, 1, 2, 0, 1, 0, 1)))
    assert got["a"] == a
    assert got["c"] == dict(zip(names, (0, 1, 2, 0, 2, 0, 5, 1, 1, 2, 1, 0, 1, 0)))
    assert got["t"] == dict.fromkeys(names, 0)
    assert got["d"] == dict.fromkeys(names, 0) | {"crossed_interfaces": 1}
    none = atlas.metric_profile(modules.limit(0), deps.limit(0), calls.limit(0), targets.limit(0), links.limit(0))
    assert none.columns == ["node", *(c for c in none.columns if c in [*names, "component"])] and none.count() == 0
    rows = atlas.metric_profile(modules, deps, calls, targets, links).select("node", "component").collect()
    assert {r.node: r.component for r in rows} == {"a": "a", "b": "a", "c": None, "t": None, "d": None}


def test_representative_paths_against_search(spark):
    import collections

    pairs = [(f"v{k:02}", f"v{k + 1:02}") for k in range(30)] + [("v03", "w1"), ("w1", "v10"), ("v00", "v05")]
    near = collections.defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
    want = {}
    for start in list(near):
        seen, front = {start: (start,)}, [(start,)]
        while front and len(front[0]) < 20:
            step = {}
            for p in front:
                for b in near.get(p[-1], ()):
                    if b not in seen and (b not in step or p + (b,) < step[b]):
                        step[b] = p + (b,)
            seen |= step
            front = list(step.values())
        far = max(map(len, seen.values()))
        want[start] = min(p for p in seen.values() if len(p) == far)
    e = spark.createDataFrame(pairs, "src string, dst string")
    got = graph.representative_paths(e, e.selectExpr("src as start").distinct())
    assert {r.start: tuple(r.path) for r in got.collect()} == want
    assert len(graph.shortest_path(e, "v00", "v30").collect()) == 26


def test_centre_clusters_and_store(spark, tmp_path):
    from lattica.operators import structure
    from lattica.sources import atlas_store

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdexyz"], "node string")
    got = {r.node: (r.seed, r.distance) for r in structure.centre_clusters(e, nodes).collect()}  # two seeds of eight nodes, halves go to even
    assert got["b"] == ("b", 0) and got["a"] == ("b", 1) and {got[n][1] for n in "yz"} <= {0, 1, 1000} and got["e"] == ("b", 3)
    at = f"file://{tmp_path}/atlas"
    with pytest.raises(KeyError):
        atlas_store.load(spark, at, "v", "nodes")
    with pytest.raises(ValueError):
        atlas_store.save(at, "v", {"nodes": nodes}, most_nodes=3)
    assert atlas_store.save(at, "v", {"nodes": nodes}, most_nodes=8) and not atlas_store.save(at, "v", {"nodes": nodes})
    assert [r.node for r in atlas_store.load(spark, at, "v", "nodes", "node").collect()] == list("abcdexyz")
    with pytest.raises(ValueError):
        atlas_store.refuse_large(spark.createDataFrame([(5,), (6,)], "size long"), "size", 10)


def test_nested_bodies_scan_and_config(spark, tmp_path):
    source = "class A:\n    def m(self, a: int, *b, c=1) -> str:\n        def inner():\n            return helper(a)\n        return inner()\n\ndef helper(x):\n    return x\n\nuse = helper\n"
    rows = code.parse(spark.createDataFrame([("p/one.py", source)], "path string, source string"))
    assert {(r.src, r.dst) for r in code.call_edges(rows).collect()} == {("p.one.A.m.inner", "p.one.helper"), ("p.one.A.m", "p.one.A.m.inner")}
    assert ("p.one", "p.one.helper") in {(r.src, r.dst) for r in code.reference_edges(rows).collect()}
    o = code.operations(rows, "CLASS").first()
    assert (o["class"], o.operation, o.is_async, o.arity, o.annotations) == ("p.one.A", "m", False, 2, ["int", "", "str"])
    assert {r.name: r.value for r in rows.where("kind = 'metric' and qualified = 'p.one.A.m'").collect()} == {"statements": "3", "branches": "0", "nesting": "0", "parameters": "4", "public_symbols": "1", "imports": "0", "lines": "4"}
    for k in "cab":
        (tmp_path / f"{k}.py").write_text(f"{k} = 1")
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "x.yaml").write_text("k: v")
    assert sorted(r.path for r in code.scan(spark, str(tmp_path), max_files=2).collect()) == ["a.py", "b.py"]
    assert [r.path for r in code.scan(spark, str(tmp_path), config=True).collect()] == ["venv/x.yaml"]
    assert sorted(r.path for r in code.scan(spark, str(tmp_path), exclude=["a.py"], max_bytes=5).collect()) == ["b.py", "c.py"]


def test_answers_to_no_question_are_an_error(spark):
    q = spark.createDataFrame([(1,), (2,)], "id int")
    a = spark.createDataFrame([(2, "ANSWERED", "yes", "ann")], "id int, status string, value string, actor string")
    got = {tuple(r) for r in delta.completed_answers(q, a, ["id"]).collect()}
    assert got == {(1, "SKIPPED", None, "user"), (2, "ANSWERED", "yes", "ann")}
    with pytest.raises(ValueError):
        delta.completed_answers(q, a.withColumn("id", F.lit(3)), ["id"])


def test_docket_sorts_as_people_do(spark):
    from lattica.operators import report

    rows = [(1, False, "material", "b"), (2, True, "cleared", "Zebra"), (3, True, "cleared", "apple"), (4, True, "cleared", "Äpfel"), (5, True, "odd", "a"), (6, False, "held", "a"), (7, True, "cleared", "apple")]
    df = spark.createDataFrame(rows, "finding int, moved boolean, verdict string, summary string")
    got = report.docket(df, 6)
    assert [r.finding for r in got.orderBy("place").collect()] == [4, 3, 7, 2, 5, 1] and got.count() == 6


def test_documents(spark):
    from lattica.operators import documents

    rows = [('{"b": {"y": 1, "x": [2, {"d": 1, "c": null}]}, "a": "ü"}', None), ("[1]", "n"), (None, None), ('{"base": "old"}', "old")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, doc string, base string")
    assert [r.c for r in df.select(documents.canonical(F.col("doc")).alias("c")).collect()] == ['{"a":"ü","b":{"x":[2,{"c":null,"d":1}],"y":1}}', "[1]", None, '{"base":"old"}']
    values = spark.createDataFrame([(0, "new"), (1, "new"), (2, "new"), (3, "new")], "id int, base string")
    got = {r.id: (r.base, r.doc) for r in documents.fill_once(df, values, ["id"], "base", "doc").collect()}
    assert got[0] == ("new", '{"a":"ü","b":{"x":[2,{"c":null,"d":1}],"y":1},"base":"new"}') and got[1] == ("n", "[1]") and got[2] == ("new", None) and got[3] == ("old", '{"base": "old"}')
    review = '{"findings": [{"verdict": "held", "x": 1}, {"verdict": "held"}, {}], "case": {"answers": []}, "delta": {"new": [1, 2]}}'
    t = documents.tallies(spark.createDataFrame([(review,), (None,), ("{}",)], "doc string"), "doc").collect()
    assert (t[0].findings, t[0].held, t[0].material, t[0].answers, t[0].new, t[0].changed) == (3, 2, 0, 0, 2, 0) and t[1].findings == t[2].held == 0


def test_fingerprint_and_folders(spark):
    files = spark.createDataFrame([(f"src/tests/f{k}.py", f"x = {k}", k) for k in range(50)] + [("top.py", "", 7)], "path string, text string, size long")
    whole = lambda df: detectors.content_fingerprint(df, "path", F.col("text")).first().fingerprint
    assert whole(files) == whole(files.repartition(7).orderBy(F.col("path").desc())) != whole(files.where("path <> 'top.py'"))
    assert whole(files) != whole(files.withColumn("text", F.when(F.col("path") == "top.py", " ").otherwise(F.col("text"))))
    rows, totals = detectors.folder_tree(files, "path", "size")
    assert [tuple(r) for r in rows.collect()] == [("src", 50, 1225, False), ("src/tests", 50, 1225, True)] and tuple(totals.first()) == (51, 1232)
    assert tuple(detectors.folder_tree(files.limit(0), "path", "size")[1].first()) == (0, 0)


def test_measures_of_owners_and_their_metadata(spark):
    owners = spark.createDataFrame([("f", "m"), ("g", None), ("h", "gone")], "node string, owner string")
    profile = spark.createDataFrame([("m", 3, None)], "node string, fan_in int, depth int")
    assert {tuple(r) for r in atlas.inherited(owners, profile).collect()} == {("f", 3, 0), ("g", 0, 0), ("h", 0, 0)}
    rows = spark.createDataFrame([("a", "local.branch_count", 1.0), ("a", "cognitive_scope.abstraction_boundaries", 2.0), ("a", "cognitive_scope.other", 2.0)], "node string, metric string, value double")
    said = spark.createDataFrame([("local.branch_count", "Branches.", "Static.")], "metric string, definition string, limitations string")
    got = {r.metric: tuple(r)[3:] for r in atlas.described(rows, said).collect()}
    assert got["local.branch_count"] == ("measurement", "lexical_node", "Branches.", "Static.")
    assert got["cognitive_scope.abstraction_boundaries"][:2] == ("structural_proxy", "bounded_resolved_call_chain")
    assert got["cognitive_scope.other"] == ("structural_proxy", "reverse_static_impact_neighbourhood", "Static value of cognitive scope / other.", "")


def test_first_and_empty_reports(spark):
    from lattica.operators import report

    reviews = spark.createDataFrame([("r", "Shop", 1, None, False, ["x"]), ("s", "Mill", 4, 3, True, [])], "repository string, name string, sequence int, previous int, waiting boolean, sources array<string>")
    findings = spark.createDataFrame([("r", "b", "held", "s", ["no types"]), ("r", "A", "held", "t", ["no types"])], "repository string, finding string, verdict string, summary string, limits array<string>")
    moves = spark.createDataFrame([("r", "new", "b", None), ("s", "addressed", "c", None)], "repository string, state string, finding string, causes string")
    questions = spark.createDataFrame([("s", "Why?", "intent")], "repository string, question string, facet string")
    answers = spark.createDataFrame([("r", "Who?", None, "user")], "repository string, question string, value string, actor string")
    got = {r.repository: r.report for r in report.markdown_report(report.review_sections(reviews, findings, moves, questions, answers)).collect()}
    assert "2 candidates judged: 0 material, 2 held, 0 cleared.\n" in got["r"] and "## Held (2)\n\n- Waits on what the sources cannot tell.\n- A: t\n- b: s\n" in got["r"] and "new: b" not in got["r"]
    assert "- held: no types\n" in got["r"] and "Who?: skipped (user)" in got["r"] and "question" not in got["r"]
    assert "No candidates were found" in got["s"] and "- addressed: c\n" in got["s"] and "## Open questions\n\n- Why? (intent)" in got["s"] and "## What could not be seen\n\nNone." in got["s"]


def test_yaml_results_are_yaml(spark, tmp_path):
    from lattica.operators import report

    yaml = pytest.importorskip("yaml")
    rows = spark.createDataFrame([(1, "a: b\n#c", ["x"]), (2, None, [])], "id int, note string, tags array<string>")
    report.write_results(rows.coalesce(1), f"file://{tmp_path}/y", "yaml")
    (part,) = (tmp_path / "y").glob("part-*")
    assert yaml.safe_load(part.read_text()) == [{"id": 1, "note": "a: b\n#c", "tags": ["x"]}, {"id": 2, "note": None, "tags": []}]
    with pytest.raises(ValueError):
        report.write_results(rows, f"file://{tmp_path}/z", "xml")


def test_conformance_meets_on_the_rarest_operation(spark):
    from lattica.operators import structure

    w = [("I", "close", False, 0, [""]), ("I", "rare", False, 1, ["int", ""]), ("J", "close", False, 0, [""]), ("K", "gone", False, 0, [""]), ("L", "rare", False, 1, ["int", "str"])]
    o = [(f"c{k}", "close", False, 0, [""]) for k in range(30)] + [("c1", "rare", False, 1, ["int", "str"]), ("c2", "rare", False, 1, ["str", ""]), ("c3", "rare", True, 1, ["int", ""]), ("d", "rare", False, 1, ["int", "str"])]
    cols = "operation string, is_async boolean, arity int, annotations array<string>"
    got = structure.conformance(spark.createDataFrame(w, f"interface string, {cols}"), spark.createDataFrame(o, f"class string, {cols}"), spark.createDataFrame([("d", "L")], "class string, interface string"))
    assert {tuple(r) for r in got.collect()} == {("c1", "I", 2, 1), ("c1", "L", 1, 2)}


def test_cycle_signals_name_all_members(spark):
    component = spark.createDataFrame([("b", "a"), ("a", "a"), ("c", "a"), ("d", "d")], "node string, component string")
    e = spark.createDataFrame([("a", "b", "1"), ("b", "c", "2"), ("c", "a", "3"), ("c", "d", "0")], "src string, dst string, edge_id string")
    got = {tuple(r) for r in detectors.cycle_signals(component, e).select("node", "component", "members", "size", "first_edge").collect()}
    assert got == {("a", "a", "a,b,c", 3, "1"), ("b", "a", "a,b,c", 3, "2"), ("c", "a", "a,b,c", 3, "3")}


def test_cycle_signals_shuffle_names_by_lists_not_by_rows(spark, monkeypatch, tmp_path):
    """400 members of 3,000 letters each: all names in every row are 480 MB, a shuffle of them is what failed."""
    monkeypatch.setattr(detectors, "LARGE", 50)
    name = F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.repeat(F.lit("x"), 3000))
    nodes = spark.range(400).select(name.alias("node"))
    component = nodes.select("node", F.lit("c").alias("component"))
    e = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.substring("node", 1, 4).alias("edge_id"))
    df = detectors.cycle_signals(component, e)
    rows = df.select("size", "first_edge", F.length("members").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert sorted((r["size"], r["first_edge"], r["n"]) for r in rows) == [(400, f"{k:04d}", 400 * 3004 + 399) for k in range(400)]
    tasks = [r["task"] for r in rows]
    assert max(tasks.count(t) for t in set(tasks)) < 400  # rows of a component came from one task
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().split("\n")[1].strip(" +-").startswith("Generate explode")  # rows are put out after the last join


def test_conforming_groups_hold_every_pair(spark):
    ops = {"one": [("put", False, 2, ["str", "int", "bool"])], "two": [("get", False, 1, ["str", "str"]), ("put", False, 2, ["str", "int", "bool"])], "bad": [("put", False, 2, ["bytes", "int", "bool"])]}
    rows = lambda named: [(n, *o) for n, kind in named for o in ops[kind]]
    form = "operation string, is_async boolean, arity int, annotations array<string>"
    wanted = spark.createDataFrame(rows([("P1", "one"), ("P2", "one"), ("P3", "one"), ("P4", "two")]), "interface string, " + form)
    offered = spark.createDataFrame(rows([("C1", "one"), ("C2", "one"), ("C3", "two"), ("C4", "two"), ("C5", "bad"), ("C6", "one")]), "class string, " + form)
    known = spark.createDataFrame([("C2", "P2"), ("C3", "P4")], "class string, interface string")
    want = {tuple(r) for r in structure.conformance(wanted, offered, known).collect()}
    got = structure.conforming_groups(wanted, offered, known).collect()
    of = {role: {} for role in ("class", "interface")}
    for r in got:
        if r["role"] != "pair":
            of[r["role"]].setdefault(r["of"], []).append(r["name"])
    assert {(c, i, r["operations"], r["agreements"]) for r in got if r["role"] == "pair" for c in of["class"][r["name"]] for i in of["interface"][r["of"]]} == want
    assert sorted(of["class"]["C1"]) == ["C1", "C6"]


def test_parsed_conformance_has_a_row_for_every_class_and_interface(spark, monkeypatch, tmp_path):
    """Every supplier's class conforms to every supplier's interface; lists of four make the pairs."""
    from lattica.operators import structure
    from lattica.plans import record_queries

    monkeypatch.setattr(structure, "LARGE", 4)
    spark.range(1, 12).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = [tuple(r) for r in record_queries.QUERIES["parsed_conformance"](spark, str(tmp_path)).select("class", "interface", "operations", "agreements").collect()]
    assert sorted(got) == sorted((f"pkg.disk{c}.Disk{c}", f"pkg.port{i}.Port{i}", 1, 3) for c in range(1, 12) for i in range(1, 12))

"""The closed set of atlas queries: summaries, relations, hotspots, search, context."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import table
from lattica.operators import graph

#: kind -> edge types, and whether the node is the target
RELATIONS = {
    "direct_dependencies": (("IMPORTS", "CALLS"), False),
    "direct_dependants": (("IMPORTS", "CALLS"), True),
    "known_callers": (("CALLS",), True),
    "implementations": (("IMPLEMENTS",), True),
    "related_tests": (("TESTS",), True),
}
#: group and field of an unqualified metric: the first group that has it (fixed order)
GROUPS = ("local", "dependency", "change_amplification", "cognitive_scope")


def relation(edges: DataFrame, kind: str, node: str, limit: int) -> DataFrame:
    types, back = RELATIONS[kind]
    near, far = ("dst", "src") if back else ("src", "dst")
    rows = edges.where(F.col("edge_type").isin(*types) & (F.col(near) == node))
    return rows.select(F.col(far).alias("node")).distinct().orderBy("node").limit(limit)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("node")
    return edges.join(ids.select(F.col("node").alias("src")), "src", "left_semi").join(ids.select(F.col("node").alias("dst")), "dst", "left_semi")


def search(nodes: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Nodes whose lowered name and id hold all terms."""
    text = F.lower(F.concat_ws(" ", "name", "node"))
    for term in terms:
        nodes = nodes.where(F.contains(text, F.lit(term.lower())))
    return nodes.select("node", "name").orderBy("name", "node").limit(limit)


def hotspots(values: DataFrame, limit: int) -> DataFrame:
    """(node, value, rank): greatest first, ties by id."""
    top = values.orderBy(F.col("value").desc(), "node").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc(), "node")))  # over limit rows


def by_type(nodes: DataFrame, order: list[str], limit: int) -> DataFrame:
    place = F.coalesce(*[F.when(F.col("node_type") == k, i) for i, k in enumerate(order)], F.lit(len(order)))
    return nodes.orderBy(place, "name", "node").limit(limit).select("node", "node_type", "name")


def details(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    n = edges.where((F.col("src") == node) | (F.col("dst") == node)).agg(F.count("*").alias("edges"))
    return nodes.where(F.col("node") == node).crossJoin(F.broadcast(n)).select("node", "node_type", "name", "parent", "edges")


def known(nodes: DataFrame, node: str) -> str:
    """The id, or an error where there is no such node."""
    if nodes.where(F.col("node") == node).isEmpty():
        raise KeyError(node)
    return node


def subsystem(nodes: DataFrame, contains: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Per node type of what a node holds, itself included: how many, and the edges inside and out of it."""
    start = nodes.sparkSession.createDataFrame([(known(nodes, node),)], "start string")
    inside = table(graph.reachable(contains, start).select("node").unionByName(start.select(F.col("start").alias("node"))), "inside")
    a, b = (inside.select(F.col("node").alias(x), F.lit(True).alias(f"{x}_in")) for x in ("src", "dst"))
    n = edges.join(a, "src").join(b, "dst", "left").agg(F.count("dst_in").alias("edges_inside"), F.count_if(F.col("dst_in").isNull()).alias("edges_out"))
    return nodes.join(inside, "node", "left_semi").groupBy("node_type").agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(n))


def full_details(nodes: DataFrame, edges: DataFrame, tests: DataFrame, node: str) -> DataFrame:
    """A node with its fan-in and -out, and the tests of it in order."""
    near = edges.where((F.col("src") == known(nodes, node)) | (F.col("dst") == node))
    n = near.agg(F.count_if(F.col("dst") == node).alias("fan_in"), F.count_if(F.col("src") == node).alias("fan_out"))
    names = tests.where((F.col("edge_type") == "TESTS") & (F.col("dst") == node)).agg(F.nullif(F.array_join(F.array_sort(F.collect_set("src")), ","), F.lit("")).alias("tests"))
    return nodes.where(F.col("node") == node).select("node", "node_type", "name", "parent").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(names))  # one row each


def signals(rows: DataFrame, code: str, codes: list[str]) -> DataFrame:
    """Rows of the codes, case ignored; an empty list means all."""
    return rows.where(F.lower(code).isin([c.lower() for c in codes])) if codes else rows


def metric_rows(profile: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(node, metric, value) of every numeric field; nulls are left out."""
    fields = [(f"{g}.{f}", f) for g, fs in groups.items() for f in fs]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f).cast("double").alias("value")) for m, f in fields])
    return profile.select("node", F.explode(pairs).alias("r")).select("node", "r.metric", "r.value").where("value is not null")


def resolve_metric(name: str, groups: dict[str, list[str]]) -> str:
    """Qualified name of a metric; hyphens count as underscores."""
    name = name.replace("-", "_")
    for g in GROUPS:
        if name in [f"{g}.{f}" for f in groups.get(g, [])]:
            return name
    for g in GROUPS:
        if name in groups.get(g, []):
            return f"{g}.{name}"
    raise KeyError(name)


def metric_profile(modules: DataFrame, deps: DataFrame, calls: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """Measures per module (node, is_test), 0 where none, and the component of a module on a cycle, named by its least member.

    ``deps`` and ``calls`` are edges between different modules, ``targets`` (node, target) the public
    symbols of a module that some module calls, ``links`` edges (src, dst, edge_type) of the kinds
    IMPLEMENTS, TESTS and CONFIGURES. Affected is who reaches a module by either kind of edge. A
    caller of an affected module is affected too, so the symbols that calls among the affected
    cross are all called ones that these own: a sum over components, as are affected tests.
    """

    def count(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("node")).agg(F.count("*").alias(name))

    def sources(kind: str, name: str) -> DataFrame:
        return links.where(F.col("edge_type") == kind).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias(name))

    test = F.coalesce(F.col("is_test"), F.lit(False)).cast("int")
    owned = modules.join(count(targets.select("node", "target").distinct(), "node", "crossed_interfaces"), "node", "left")
    owned = owned.select("node", F.lit(1).alias("affected"), test.alias("affected_tests"), "crossed_interfaces")

    def of_deps() -> tuple[DataFrame, DataFrame]:
        parts = graph.condense(deps)
        return graph.reach_counts(deps, parts), graph.depths(deps, modules.select("node"), parts)

    with ThreadPoolExecutor(2) as both_graphs:  # rounds of the two graphs leave each other room
        first = both_graphs.submit(of_deps)
        impact = both_graphs.submit(graph.reach_sums, graph.reverse(deps.select("src", "dst").unionByName(calls.select("src", "dst"))), owned).result()
        reach, depth = first.result()
    out = modules.withColumn("_test", test).drop("is_test")
    for part in (
        count(deps, "dst", "fan_in"),
        count(deps, "src", "fan_out"),
        reach.select("node", F.col("forward").alias("forward_reach"), F.col("reverse").alias("reverse_reach"), "scc_size", "component"),
        depth.select("node", F.col("depth").cast("long").alias("depth")),
        impact,
        calls.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("callers")),
        sources("IMPLEMENTS", "implementors"),
        sources("TESTS", "tests"),
        sources("CONFIGURES", "configurations"),
    ):
        out = out.join(part, "node", "left")
    out = out.fillna(0).withColumn("affected", F.col("affected") - 1).withColumn("affected_tests", F.col("affected_tests") - F.col("_test"))
    both = F.greatest(F.col("scc_size") - 1, F.lit(0))  # who is reached and reaches back: the rest of the cycle
    return out.withColumn("neighbourhood", F.col("forward_reach") + F.col("reverse_reach") - both).drop("_test")


def inherited(owners: DataFrame, profile: DataFrame) -> DataFrame:
    """(node, ...): every node (node, owner) with the measures (node, ...) of the module that owns it; zeros without one."""
    names = [c for c in profile.columns if c != "node"]
    own = profile.select(F.col("node").alias("owner"), *names)
    return owners.select("node", "owner").join(own, "owner", "left").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def described(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metric rows (node, metric, value) with nature, scope, definition and limitations.

    metadata: metric, definition, limitations; a metric that has none gets a definition made of its name.
    Nature and scope follow from the group, and of two cognitive measures from the chain that they count.
    """
    group, field = F.split_part("metric", F.lit("."), F.lit(1)), F.split_part("metric", F.lit("."), F.lit(2))
    chain = (group == "cognitive_scope") & field.isin("bounded_resolved_call_chain_nodes", "abstraction_boundaries")
    scope = F.when(group == "local", "lexical_node").when(group == "dependency", "owning_module").when(chain, "bounded_resolved_call_chain").otherwise("reverse_static_impact_neighbourhood")
    nature = F.when(group.isin("local", "dependency"), "measurement").otherwise("structural_proxy")
    plain = F.concat(F.lit("Static value of "), F.replace(F.replace(F.col("metric"), F.lit("_"), F.lit(" ")), F.lit("."), F.lit(" / ")), F.lit("."))
    out = rows.join(metadata.select("metric", "definition", "limitations"), "metric", "left")
    return out.select("node", "metric", "value", nature.alias("nature"), scope.alias("scope"), F.coalesce("definition", plain).alias("definition"), F.coalesce("limitations", F.lit("")).alias("limitations"))


def review_context(edges: DataFrame, anchors: list[str], limit: int) -> DataFrame:
    """(anchor, node, edge_id): neighbours of the anchors in edge order, ``limit`` new ones each.

    Greedy over anchors in their order: a neighbour that is an anchor, or that an earlier anchor
    has admitted, costs nothing. So a bounded loop over anchors, each round a join.
    """
    order = list(dict.fromkeys(anchors))
    if len(order) > 80:
        raise ValueError(f"{len(order)} anchors; a context takes 80 at most")
    spark = edges.sparkSession
    edges = table(edges.where(F.col("src").isin(order) | F.col("dst").isin(order)).select("src", "dst", "edge_id"), "touching")  # read in every round
    near = edges.select(F.col("src").alias("anchor"), F.col("dst").alias("node"), "edge_id").unionByName(edges.select(F.col("dst").alias("anchor"), F.col("src").alias("node"), "edge_id"))
    near = near.where(F.col("anchor").isin(order)).groupBy("anchor", "node").agg(F.min("edge_id").alias("edge_id"))
    free = spark.createDataFrame([(a,) for a in order], "node string")
    out = None
    for a in order:
        mine = near.where(F.col("anchor") == a)
        known = mine.join(free, "node", "left_semi").select("anchor", "node", "edge_id")
        new = mine.join(free, "node", "left_anti").orderBy("edge_id").limit(limit).select("anchor", "node", "edge_id")
        step = table(known.unionByName(new), "context")
        out = step if out is None else out.unionByName(step)
        free = free.unionByName(step.select("node")).distinct()
    return out

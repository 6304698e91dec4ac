"""One query per kind of request to an atlas, each answer in rows, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import table
from lattica.operators import graph, requests
from lattica.plans.fixtures import Tables, with_
from lattica.plans.registry import registry

QUERIES, ORACLES, query = registry()


def _atlas(t: Tables, measured: bool = False) -> requests.Atlas:
    """The graph views as an atlas: suppliers are modules (every tenth a test) whose source is a document, events are signals."""
    k = F.substring("node", 3, 20).cast("int")
    module = F.col("node_type") == "MODULE"
    kind = F.when(F.col("node_type") == "PACKAGE_ROOT", "REPOSITORY").when(module & (k % 10 == 3), "TEST_MODULE").otherwise(F.col("node_type"))
    path = F.when(module, F.concat(F.lit("d/"), k)).otherwise(F.concat(F.coalesce("parent", F.lit("")), F.lit("/"), "name"))
    nodes = t.nodes().select("node", "name", F.concat_ws(".", "parent", "name").alias("qualified_name"), kind.alias("node_type"), path.alias("path"), F.when(module, 1 + k % 4).alias("start_line"), F.when(module, 4 + k % 7).alias("end_line"), "is_public")
    contains = t.contains().withColumn("edge_type", F.lit("CONTAINS"))
    edges = contains.unionByName(t.deps().withColumn("edge_type", F.lit("IMPORTS"))).unionByName(t.calls().withColumn("edge_type", F.lit("CALLS"))).unionByName(t.links())
    edges = table(edges.select(F.concat(F.substring("edge_type", 1, 3), F.lit(":"), "src", F.lit(">"), "dst").alias("edge_id"), "src", "dst", "edge_type"), "atlas_edges")
    signals = t.events.select(F.col("event_id").alias("position"), F.concat(F.lit("s:"), "user_id").alias("node"), F.when(F.col("event_type") == "error", "cyclic-dependency").otherwise(F.col("event_type")).alias("code"))
    files = t.documents.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.col("text").alias("source"))
    return requests.Atlas(nodes, edges, _metrics(t, edges) if measured else None, signals, files)


def _metrics(t: Tables, edges: DataFrame) -> DataFrame:
    deps = edges.where("edge_type = 'IMPORTS'").select("src", "dst")
    parts = graph.components(deps, t.modules())
    size = parts.join(parts.groupBy("component").agg(F.count("*").alias("n")), "component")
    rows = deps.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).withColumn("metric", F.lit("dependency.fan_in"))
    rows = rows.unionByName(deps.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).withColumn("metric", F.lit("change_amplification.fan_out")))
    rows = rows.unionByName(size.select("node", "n", F.lit("dependency.cycle_size").alias("metric")))
    return table(rows.select("node", "metric", F.col("n").cast("double").alias("value")), "atlas_metrics")


ATLAS = """atlas as (select node, name, concat_ws('.', parent, name) as qualified_name,
  case when node_type = 'PACKAGE_ROOT' then 'REPOSITORY' when node_type = 'MODULE' and cast(substr(node, 3) as int) % 10 = 3 then 'TEST_MODULE' else node_type end as node_type,
  case when node_type = 'MODULE' then 'd/' || substr(node, 3) else coalesce(parent, '') || '/' || name end as path,
  case when node_type = 'MODULE' then 1 + cast(substr(node, 3) as int) % 4 end as start_line, case when node_type = 'MODULE' then 4 + cast(substr(node, 3) as int) % 7 end as end_line, is_public from nodes),
 edges as (select substr(edge_type, 1, 3) || ':' || src || '>' || dst as edge_id, src, dst, edge_type from (
  select src, dst, 'CONTAINS' as edge_type from contains union all select src, dst, 'IMPORTS' from deps union all select src, dst, 'CALLS' from calls union all select src, dst, edge_type from links)),
 sig as (select event_id as position, 's:' || user_id as node, case when event_type = 'error' then 'cyclic-dependency' else event_type end as code from events),
 near as (select distinct src, dst from edges where edge_type in ('IMPORTS', 'CALLS'))"""
METRICS = """scc as (select m.node, least(m.node, coalesce(min(b.node), m.node)) as component from modules m
  left join (select a.start, a.node from reach a join reach c on c.start = a.node and c.node = a.start) b on b.start = m.node group by m.node),
 met as (select dst as node, 'dependency.fan_in' as metric, cast(count(*) as double) as value from deps group by dst union all select src, 'change_amplification.fan_out', count(*) from deps group by src
  union all select node, 'dependency.cycle_size', count(*) over (partition by component) from scc)"""
#: rows of an answer whose selected nodes are ids (node, position)
NODES = "select 'node' as section, cast(position as bigint) as position, i.node as id, concat_ws('|', qualified_name, node_type, path, concat_ws(':', case when end_line is not null then start_line end, case when start_line is not null then end_line end), cast(is_public as varchar)) as detail, cast(null as double) as value from ids i join atlas a on a.node = i.node"
WITHIN = "select 'edge', null, edge_id, concat_ws('|', src, dst, edge_type), null from edges where src in (select node from ids) and dst in (select node from ids)"
TESTS = "select 'test', null, node, null, null from (select node from atlas where node_type in ('TEST_MODULE', 'TEST_FUNCTION') and node in (select node from ids) union select src from edges where edge_type = 'TESTS' and dst in (select node from ids))"


def _matched(n: str, truncated: str, *more: str) -> str:
    said = "".join(f" union all select 'matched', null, '{m.split(' = ')[0]}', null, cast(({m.split(' = ')[1]}) as double)" for m in more)
    return f"select 'matched', null, 'n', null, cast(({n}) as double) union all select 'matched', null, 'truncated', null, cast(cast(({truncated}) as int) as double){said}"


def _answer(*parts: str, names: tuple[str, ...] = (), ids: str) -> str:
    return with_("nodes", "modules", "contains", "follows", "deps", "calls", "links", ATLAS, *names, ids, body=" union all ".join(parts), recursive=True)


def ask(name: str, sql: str, measured: bool = False, **request):
    @query(name, sql)
    def _(t: Tables) -> DataFrame:
        return requests.flat(requests.run(_atlas(t, measured), request))


def _limited(rows: str, order: str, limit: int) -> tuple[str, str, str]:
    """CTE ids, the count and the truncated flag, of ``rows`` (a select of node and what it is ordered by)."""
    ids = f"pool as ({rows}),\n ids as (select node, row_number() over (order by {order}) as position from pool qualify position <= {limit})"
    return ids, f"least((select count(*) from pool), {limit})", f"(select count(*) from pool) > {limit}"


_place = "case node_type when 'REPOSITORY' then 0 when 'PACKAGE' then 1 when 'MODULE' then 2 when 'TEST_MODULE' then 3 when 'CLASS' then 6 end"
_ids, _n, _more = _limited(f"select node, {_place} as place, qualified_name from atlas", "place, qualified_name, node", 40)
ask(
    "ask_repository_summary",
    _answer(NODES, _matched(_n, _more, "all_nodes = select count(*) from atlas", "all_edges = select count(*) from edges", "all_signals = select count(*) from sig"), f"(select * from ({WITHIN}) order by edge_id limit 40)", "(select 'signal', position, node, code, null from sig order by position limit 40)", ids=_ids),
    kind="repository_summary",
    limit=40,
)

WALK = """walk as (select '{start}' as node, 0 as depth, ['{start}'] as path union all select {far}, depth + 1, list_append(path, {far}) from walk join {edges} on {back} = node where depth < {depth}),
 first as (select node, min(depth) as depth from walk group by node),
 best as (select w.node, w.depth, min(w.path) as path from walk w join first f on w.node = f.node and w.depth = f.depth where w.depth > 0 group by w.node, w.depth)"""
_ids, _n, _more = _limited("select node, depth, path from best", "depth, path", 30)
ask(
    "ask_subsystem_summary",
    _answer(NODES, _matched(_n, _more), "select 'edge', null, edge_id, concat_ws('|', src, dst, edge_type), null from edges where edge_type = 'CONTAINS' and dst in (select node from ids)", names=("tree as (select src, dst from edges where edge_type = 'CONTAINS')", WALK.format(start="r:1", far="dst", back="src", edges="tree", depth=3)), ids=_ids),
    kind="subsystem_summary",
    node="r:1",
    limit=30,
)

ask(
    "ask_node_details",
    _answer(
        NODES, _matched("1", "false"), "select 'edge', null, edge_id, concat_ws('|', src, dst, edge_type), null from edges where src = 's:5' or dst = 's:5'",
        "select 'metric', null, node, metric, value from met where node = 's:5'", TESTS, "select 'signal', position, node, code, null from sig where node = 's:5'",
        names=("reach", METRICS), ids="ids as (select 's:5' as node, 1 as position)",
    ),
    measured=True,
    kind="node_details",
    node="s:5",
)

for _kind, _types, _back, _node in (
    ("direct_dependencies", "'IMPORTS', 'CALLS'", False, "s:2"),
    ("direct_dependants", "'IMPORTS', 'CALLS'", True, "s:2"),
    ("known_callers", "'CALLS'", True, "s:3"),
    ("implementations", "'IMPLEMENTS'", True, "s:7"),
    ("related_tests", "'TESTS'", True, "s:4"),
):
    _near, _far = ("dst", "src") if _back else ("src", "dst")
    _where = f"edge_type in ({_types}) and {_near} = '{_node}'"
    _ids, _n, _more = _limited(f"select distinct {_far} as node from edges where {_where}", "node", 2)
    ask(
        f"ask_{_kind}",
        _answer(NODES, _matched(_n, _more), f"select 'edge', null, edge_id, concat_ws('|', src, dst, edge_type), null from edges where {_where} and {_far} in (select node from ids)", TESTS, ids=_ids),
        kind=_kind,
        node=_node,
        limit=2,
    )

for _kind, _far, _back in (("forward_neighbourhood", "dst", "src"), ("reverse_neighbourhood", "src", "dst")):
    _ids, _n, _more = _limited("select node, depth, path from best", "depth, path", 25)
    _both = WITHIN.replace("select node from ids", "select node from ids union select 's:1'") + " and edge_type in ('IMPORTS', 'CALLS')"
    ask(
        f"ask_{_kind}",
        _answer(NODES, _matched(_n, _more), _both, TESTS, names=(WALK.format(start="s:1", far=_far, back=_back, edges="near", depth=3),), ids=_ids),
        kind=_kind,
        node="s:1",
        depth=3,
        limit=25,
    )

ask(
    "ask_shortest_dependency_path",
    _answer(
        NODES, _matched("greatest((select count(*) from ids) - 1, 0)", "false"),
        "select 'edge', null, edge_id, concat_ws('|', src, dst, edge_type), null from (select *, row_number() over (partition by src, dst order by edge_id) as k from edges join hops using (src, dst) where edge_type in ('IMPORTS', 'CALLS')) where k = 1", TESTS,
        names=(WALK.format(start="s:1", far="dst", back="src", edges="near", depth=7), "way as (select path from best where node = 's:8')"),
        ids="ids as (select unnest(range(1, len(path) + 1)) as position, unnest(path) as node from way),\n hops as (select a.node as src, b.node as dst from ids a join ids b on b.position = a.position + 1)",
    ),
    kind="shortest_dependency_path",
    source="s:1",
    target="s:8",
)

_ids, _n, _more = _limited("select node, value from met where metric = 'dependency.cycle_size' and value > 1", "value desc, node", 20)
ask(
    "ask_cyclic_components",
    _answer(
        NODES, _matched(_n, _more), WITHIN + " and edge_type in ('IMPORTS', 'CALLS')", "select 'metric', null, node, metric, value from met where metric = 'dependency.cycle_size' and node in (select node from ids)",
        "select 'signal', position, node, code, null from sig where code = 'cyclic-dependency' and node in (select node from ids)", names=("reach", METRICS), ids=_ids,
    ),
    measured=True,
    kind="cyclic_components",
    limit=20,
)

ask(
    "ask_signals",
    _answer(
        NODES, _matched("least((select count(*) from sig where lower(code) in ('click', 'view')), 30)", "(select count(*) from sig where lower(code) in ('click', 'view')) > 30"), WITHIN, TESTS, "select 'signal', place, node, code, null from pool",
        ids="pool as (select *, row_number() over (order by position) as place from sig where lower(code) in ('click', 'view') order by position limit 30),\n ids as (select node, row_number() over (order by min(place)) as position from pool group by node)",
    ),
    kind="signals",
    codes=["CLICK", "View"],
    limit=30,
)

_ids, _n, _more = _limited("select node, value from met where metric = 'change_amplification.fan_out'", "value desc, node", 12)
ask(
    "ask_hotspots",
    _answer(NODES, _matched(_n, _more), "select 'metric', i.position, node, metric, value from met join ids i using (node) where metric = 'change_amplification.fan_out'", TESTS, names=("reach", METRICS), ids=_ids),
    measured=True,
    kind="hotspots",
    metric="fan-out",
    limit=12,
)

_hits = "contains(lower(name || ' ' || qualified_name || ' ' || path), 'supplier') and contains(lower(name || ' ' || qualified_name || ' ' || path), '1')"
_ids, _, _more = _limited(f"select node, qualified_name from atlas where {_hits}", "qualified_name, node", 15)
ask("ask_search_nodes", _answer(NODES, _matched("select count(*) from pool", _more), ids=_ids), kind="search_nodes", terms=["Supplier", "1"], limit=15)

ask(
    "ask_source_excerpt",
    _answer(
        NODES, _matched("1", "false"), "select 'line', k, null, printf('%5d | %s', k, l), null from (select unnest(range(1, len(string_split(text, chr(10))) + 1)) as k, unnest(string_split(text, chr(10))) as l from documents where doc_id = 6) where k between 1 and 12",
        ids="ids as (select 's:6' as node, 1 as position)",
    ),
    kind="source_excerpt",
    node="s:6",
    context=2,
    lines=200,
)

CONTEXT = """found as (select node, row_number() over (order by min(k), node) as position from (select 's:2' as node, 0 as k union all select 's:1', 1 union all select 's:2', 2 union all select 's:5', 3 union all select 'none', 4
   union all select node, 5 from atlas where qualified_name = 'AFRICA') join atlas using (node) group by node),
 touch as (select f.position, e.node, min(edge_id) as edge_id from found f join (select src as anchor, dst as node, edge_id from edges union all select dst, src, edge_id from edges) e on e.anchor = f.node
   where e.node in (select node from atlas) group by f.position, e.node),
 lists as (select position, list(node order by edge_id) as nodes from touch group by position),
 greedy as (select 0 as k, (select list(node order by position) from found) as inside union all
   select k + 1, list_concat(inside, coalesce(list_filter(nodes, lambda x: not list_contains(inside, x))[1:4], [])) from greedy left join lists on lists.position = k + 1 where k < (select count(*) from found)),
 ids as (select unnest(range(1, len(inside) + 1)) as position, unnest(inside) as node from greedy where k = (select count(*) from found))"""
ask(
    "ask_review_context",
    _answer(
        NODES, _matched("select count(*) from found", "false", "asked = select 5", "in_context = select count(*) from ids"), WITHIN, "select 'metric', null, node, metric, value from met where node in (select node from ids)", TESTS,
        "select 'signal', position, node, code, null from sig where node in (select node from ids)", names=("reach", METRICS), ids=CONTEXT,
    ),
    measured=True,
    kind="review_context",
    nodes=["s:2", "s:1", "s:2", "s:5", "none"],
    names=["AFRICA", "nobody"],
    limit=4,
)

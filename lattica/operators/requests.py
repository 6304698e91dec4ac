"""Typed requests to an atlas: fields checked against their bounds, each shape a handful of joins.

A request selects a bounded list of nodes (``limit`` + 1 rows are taken, so an answer knows whether
something was cut) and what stands around it. An answer is a set of lazy DataFrames; nothing of an
atlas is collected but whether an id exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import MISSING, dataclass, field, fields
from functools import partial
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import ship
from lattica.operators import atlas as ops
from lattica.operators import graph


class RequestError(ValueError):
    """A request that is out of bounds, or about something that the atlas doesn't have."""


def whole(least: int, most: int, default: int) -> Any:
    return field(default=default, metadata={"least": least, "most": most})


def texts(most: int, least: int = 0) -> Any:
    return field(default=(), metadata={"least": least, "most": most, "list": True})


@dataclass(frozen=True)
class Request:
    kind: str

    def __post_init__(self) -> None:
        for f in fields(self):
            value, least, most = getattr(self, f.name), f.metadata.get("least"), f.metadata.get("most")
            if f.metadata.get("list"):
                if not isinstance(value, (list, tuple)) or any(not isinstance(x, str) for x in value) or not least <= len(value) <= most:
                    raise RequestError(f"{f.name}: {least} to {most} texts")
                object.__setattr__(self, f.name, tuple(value))
            elif least is not None:
                if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
                    raise RequestError(f"{f.name}: a whole number from {least} to {most}")
            elif not isinstance(value, str):
                raise RequestError(f"{f.name}: a text")


@dataclass(frozen=True)
class Repository(Request):
    limit: int = whole(1, 100, 20)


@dataclass(frozen=True)
class Subsystem(Request):
    node: str
    limit: int = whole(1, 100, 20)


@dataclass(frozen=True)
class Details(Request):
    node: str


@dataclass(frozen=True)
class Relation(Request):
    node: str
    limit: int = whole(1, 100, 30)


@dataclass(frozen=True)
class Neighbourhood(Request):
    node: str
    depth: int = whole(1, 5, 2)
    limit: int = whole(1, 100, 30)


@dataclass(frozen=True)
class Path(Request):
    source: str
    target: str


@dataclass(frozen=True)
class Cycles(Request):
    limit: int = whole(1, 100, 30)


@dataclass(frozen=True)
class Signals(Request):
    codes: tuple[str, ...] = texts(10)
    limit: int = whole(1, 100, 20)


@dataclass(frozen=True)
class Hotspots(Request):
    metric: str
    limit: int = whole(1, 100, 10)


@dataclass(frozen=True)
class Search(Request):
    terms: tuple[str, ...] = texts(10, 1)
    limit: int = whole(1, 100, 20)


@dataclass(frozen=True)
class Excerpt(Request):
    node: str
    context: int = whole(0, 20, 3)
    lines: int = whole(1, 200, 80)


@dataclass(frozen=True)
class Context(Request):
    nodes: tuple[str, ...] = texts(40)
    names: tuple[str, ...] = texts(40)
    limit: int = whole(1, 100, 25)

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.nodes and not self.names:
            raise RequestError("a node or a name")


#: what may be asked, by kind
SHAPES: dict[str, type[Request]] = {
    "repository_summary": Repository,
    "subsystem_summary": Subsystem,
    "node_details": Details,
    **dict.fromkeys(ops.RELATIONS, Relation),
    "forward_neighbourhood": Neighbourhood,
    "reverse_neighbourhood": Neighbourhood,
    "shortest_dependency_path": Path,
    "cyclic_components": Cycles,
    "signals": Signals,
    "hotspots": Hotspots,
    "search_nodes": Search,
    "source_excerpt": Excerpt,
    "review_context": Context,
}
MOST_REQUESTS = 20


def parse(raw: dict[str, Any]) -> Request:
    """The request that a mapping describes; an error names the field that is unknown, missing or out of bounds."""
    shape = SHAPES.get(raw.get("kind"))
    if shape is None:
        raise RequestError(f"kind: one of {', '.join(SHAPES)}")
    known = {f.name: f for f in fields(shape)}
    if extra := sorted(set(raw) - set(known)):
        raise RequestError(f"unknown field {extra[0]}")
    if missing := [n for n, f in known.items() if f.default is MISSING and n not in raw]:
        raise RequestError(f"missing field {missing[0]}")
    return shape(**raw)


class Atlas(NamedTuple):
    """nodes (node, name, qualified_name, node_type, path, start_line, end_line, is_public), edges
    (edge_id, src, dst, edge_type), metrics (node, metric, value), signals (position, node, code) and
    files (path, source); recorded and current have fields of the header to compare (see ``stale``)."""

    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame | None = None
    signals: DataFrame | None = None
    files: DataFrame | None = None
    recorded: dict[str, str | None] | None = None
    current: dict[str, str | None] | None = None


class Answer(NamedTuple):
    """Selected nodes (position, node, ...) and what stands around them; ``matched`` has one row (n, truncated)."""

    nodes: DataFrame
    matched: DataFrame
    edges: DataFrame | None = None
    metrics: DataFrame | None = None
    tests: DataFrame | None = None
    signals: DataFrame | None = None
    excerpts: DataFrame | None = None


DEPENDS = ("IMPORTS", "CALLS")
TYPES = ("REPOSITORY", "PACKAGE", "MODULE", "TEST_MODULE", "CONFIGURATION", "INTERFACE", "CLASS", "FUNCTION", "METHOD", "TEST_FUNCTION")  # order of a summary (fixed values)
HEADER = (("parser_version", False), ("config", False), ("repository", True), ("content", True))  # fields of a header, and whether each must be known


def stale(recorded: dict[str, str | None], current: dict[str, str | None]) -> str:
    """Names of the fields that differ, joined by "and"; what is optional and unknown now doesn't count."""
    return " and ".join(name for name, must in HEADER if recorded.get(name) != current.get(name) and (must or current.get(name) is not None))


def need(atlas: Atlas, node: str) -> str:
    if atlas.nodes.where(F.col("node") == node).isEmpty():
        raise RequestError(f"unknown node {node}")
    return node


def span_summary(nodes: DataFrame, *more: str) -> DataFrame:
    """Summary of nodes: a location only where both lines are known."""
    location = F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.struct("path", "start_line", "end_line"))
    return nodes.select(*more, "node", "qualified_name", "node_type", "path", location.alias("location"), "is_public")


def _top(rows: DataFrame, limit: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows with a position, and how many that are and whether there are more."""
    taken = rows.orderBy(*order).limit(limit + 1)
    taken = taken.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # over limit + 1 rows
    matched = taken.agg(F.least(F.count("*"), F.lit(limit)).alias("n"), (F.count("*") > limit).alias("truncated"))
    return taken.where(F.col("position") <= limit), matched


def _shown(atlas: Atlas, ids: DataFrame) -> DataFrame:
    """Summaries of (position, node); ids that are no node have none."""
    return span_summary(ids.select("position", "node").join(atlas.nodes, "node"), "position")


def within(edges: DataFrame, ids: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Edges (of the types) with both ends among the ids."""
    return ops.induced(edges.where(F.col("edge_type").isin(*types)) if types else edges, ids)


def tests_of(atlas: Atlas, ids: DataFrame) -> DataFrame:
    """(node): tests among the ids, and what tests one of them."""
    own = atlas.nodes.where(F.col("node_type").isin("TEST_MODULE", "TEST_FUNCTION")).join(ids.select("node"), "node", "left_semi").select("node")
    by = atlas.edges.where("edge_type = 'TESTS'").join(ids.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return own.unionByName(by).distinct()


def _of(rows: DataFrame | None, ids: DataFrame) -> DataFrame | None:
    return None if rows is None else rows.join(ids.select("node").distinct(), "node", "left_semi")


def depends(atlas: Atlas, back: bool = False) -> DataFrame:
    e = atlas.edges.where(F.col("edge_type").isin(*DEPENDS)).select("src", "dst").distinct()
    return graph.reverse(e) if back else e


def _repository(atlas: Atlas, q: Repository) -> Answer:
    place = F.coalesce(*[F.when(F.col("node_type") == k, i) for i, k in enumerate(TYPES)], F.lit(len(TYPES)))
    ids, matched = _top(atlas.nodes.select("node", place.alias("place"), "qualified_name"), q.limit, F.col("place"), F.col("qualified_name"), F.col("node"))
    all_ = atlas.nodes.agg(F.count("*").alias("all_nodes")).crossJoin(atlas.edges.agg(F.count("*").alias("all_edges")))  # one row each
    if atlas.signals is not None:
        all_ = all_.crossJoin(atlas.signals.agg(F.count("*").alias("all_signals")))
    first = None if atlas.signals is None else atlas.signals.orderBy("position").limit(q.limit)
    return Answer(_shown(atlas, ids), matched.crossJoin(all_), within(atlas.edges, ids).orderBy("edge_id").limit(q.limit), signals=first)


def _subsystem(atlas: Atlas, q: Subsystem) -> Answer:
    contains = atlas.edges.where("edge_type = 'CONTAINS'")
    start = atlas.nodes.sparkSession.createDataFrame([(need(atlas, q.node),)], "start string")
    paths = graph.shortest_paths(contains, start).where("depth > 0").select("node", "depth", "path")
    ids, matched = _top(paths, q.limit, F.col("depth"), F.col("path"))
    return Answer(_shown(atlas, ids), matched, contains.join(ids.select(F.col("node").alias("dst")), "dst", "left_semi"))


def _details(atlas: Atlas, q: Details) -> Answer:
    ids, matched = _top(atlas.nodes.where(F.col("node") == need(atlas, q.node)).select("node"), 1, F.col("node"))
    near = atlas.edges.where((F.col("src") == q.node) | (F.col("dst") == q.node))
    return Answer(_shown(atlas, ids), matched, near, _of(atlas.metrics, ids), tests_of(atlas, ids), _of(atlas.signals, ids))


def _relation(atlas: Atlas, q: Relation) -> Answer:
    types, back = ops.RELATIONS[q.kind]
    near, far = ("dst", "src") if back else ("src", "dst")
    edges = atlas.edges.where(F.col("edge_type").isin(*types) & (F.col(near) == need(atlas, q.node)))
    ids, matched = _top(edges.select(F.col(far).alias("node")).distinct(), q.limit, F.col("node"))
    return Answer(_shown(atlas, ids), matched, edges.join(ids.select(F.col("node").alias(far)), far, "left_semi"), tests=tests_of(atlas, ids))


def _neighbourhood(atlas: Atlas, q: Neighbourhood) -> Answer:
    start = atlas.nodes.sparkSession.createDataFrame([(need(atlas, q.node),)], "start string")
    paths = graph.shortest_paths(depends(atlas, q.kind == "reverse_neighbourhood"), start, q.depth).where("depth > 0").select("node", "depth", "path")
    ids, matched = _top(paths, q.limit, F.col("depth"), F.col("path"))
    both = ids.select("node").unionByName(start.select(F.col("start").alias("node")))
    return Answer(_shown(atlas, ids), matched, within(atlas.edges, both, DEPENDS), tests=tests_of(atlas, ids))


def hop_edges(edges: DataFrame, path: DataFrame) -> DataFrame:
    """The first edge by id of each hop of a path (position, node)."""
    here = path.select("position", F.col("node").alias("src"))
    hops = here.join(path.select((F.col("position") - 1).alias("position"), F.col("node").alias("dst")), "position")
    own = hops.join(edges.where(F.col("edge_type").isin(*DEPENDS)), ["src", "dst"])
    return own.groupBy("position", "src", "dst").agg(F.min(F.struct("edge_id", "edge_type")).alias("e")).select("e.edge_id", "src", "dst", "e.edge_type")


def _path(atlas: Atlas, q: Path) -> Answer:
    found = graph.shortest_path(depends(atlas), need(atlas, q.source), need(atlas, q.target)).withColumn("position", F.col("position") + 1)
    matched = found.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n"), F.lit(False).alias("truncated"))
    return Answer(_shown(atlas, found), matched, hop_edges(atlas.edges, found), tests=tests_of(atlas, found))


def _ranked(atlas: Atlas, metric: str, limit: int, least: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = atlas.metrics.where(F.col("metric") == metric)
    rows = rows.where(F.col("value") > least) if least is not None else rows
    ids, matched = _top(rows.select("node", "value"), limit, F.col("value").desc(), F.col("node"))
    return ids, matched, ids.select("node", F.lit(metric).alias("metric"), "value", F.col("position").alias("rank"))


def _cycles(atlas: Atlas, q: Cycles) -> Answer:
    ids, matched, values = _ranked(atlas, "dependency.cycle_size", q.limit, 1)
    signals = None if atlas.signals is None else _of(atlas.signals.where("code = 'cyclic-dependency'"), ids)
    return Answer(_shown(atlas, ids), matched, within(atlas.edges, ids, DEPENDS), values.drop("rank"), signals=signals)


def _signals(atlas: Atlas, q: Signals) -> Answer:
    rows = ops.signals(atlas.signals, "code", list(q.codes))
    taken, matched = _top(rows.withColumnRenamed("position", "at"), q.limit, F.col("at"))
    first = taken.groupBy("node").agg(F.min("position").alias("at"))
    ids = first.select("node", F.row_number().over(Window.orderBy("at")).alias("position"))  # of at most limit rows
    return Answer(_shown(atlas, ids), matched, within(atlas.edges, ids), tests=tests_of(atlas, ids), signals=taken.select("position", "node", "code"))


def _hotspots(atlas: Atlas, q: Hotspots) -> Answer:
    known = {}
    for r in atlas.metrics.select("metric").distinct().limit(1_000).collect():  # names of measures, some tens
        known.setdefault(r[0].split(".")[0], []).append(r[0].split(".", 1)[1])
    try:
        metric = ops.resolve_metric(q.metric, known)
    except KeyError:
        raise RequestError(f"unknown metric {q.metric}") from None
    ids, matched, values = _ranked(atlas, metric, q.limit)
    return Answer(_shown(atlas, ids), matched, metrics=values, tests=tests_of(atlas, ids))


def _search(atlas: Atlas, q: Search) -> Answer:
    text = F.lower(F.concat_ws(" ", "name", "qualified_name", "path"))
    hits = atlas.nodes
    for term in q.terms:
        hits = hits.where(F.contains(text, F.lit(term.lower())))
    ids, _ = _top(hits.select("node", "qualified_name"), q.limit, F.col("qualified_name"), F.col("node"))
    matched = hits.agg(F.count("*").alias("n"), (F.count("*") > q.limit).alias("truncated"))  # before the limit
    return Answer(_shown(atlas, ids), matched)


def source_lines(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """(line, text) with a numbered gutter; paths that are absolute or climb are refused, like files that aren't there."""
    if path.startswith("/") or "\\" in path or ".." in path.split("/"):
        raise RequestError(f"path outside the repository: {path}")
    own = files.where(F.col("path") == path)
    if own.isEmpty():
        raise RequestError(f"no such file: {path}")
    lines = own.select(F.posexplode(F.split("source", "\n")).alias("at", "text")).select((F.col("at") + 1).alias("line"), "text")
    return lines.where(F.col("line").between(first, last)).select("line", F.format_string("%5d | %s", "line", "text").alias("text"))


def _excerpt(atlas: Atlas, q: Excerpt) -> Answer:
    if atlas.recorded is not None and (why := stale(atlas.recorded, atlas.current or {})):
        raise RequestError(f"the atlas is stale: {why}")
    node = atlas.nodes.where(F.col("node") == need(atlas, q.node)).first()
    if node.start_line is None or node.end_line is None:
        raise RequestError(f"{q.node} has no lines")
    first = max(1, node.start_line - q.context)
    last = min(node.end_line + q.context, first + q.lines - 1)
    text = source_lines(atlas.files, node.path, first, last)
    ids, matched = _top(atlas.nodes.where(F.col("node") == q.node).select("node"), 1, F.col("node"))
    return Answer(_shown(atlas, ids), matched, excerpts=text)


def _greedy(parts: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Anchors in order, each with its neighbours in order of edges; those that are in cost nothing."""
    if not (some := list(parts)):
        return
    rows = pd.concat(some, ignore_index=True)
    inside = set(rows.loc[rows.node.isna(), "anchor"])
    out = []
    for _, mine in rows.dropna(subset=["node"]).sort_values(["place", "edge_id"]).groupby("place"):
        admitted = 0
        for node in mine.node:
            if admitted == limit:
                break
            if node not in inside:
                inside.add(node)
                out.append((node, len(out)))
                admitted += 1
    yield pd.DataFrame(out, columns=["node", "at"])


def _context(atlas: Atlas, q: Context) -> Answer:
    """Anchors by id, then by name, those that are there; and neighbours, ``limit`` new ones an anchor.

    An anchor may pass over what earlier ones brought in, so of each only as many neighbours as all
    anchors together can bring in matter: that bounds the rows of the one task that goes through them.
    """
    spark = atlas.nodes.sparkSession
    ship(spark)
    by_id = spark.createDataFrame([(n, k) for k, n in enumerate(q.nodes)] or [], "node string, first int")
    by_name = spark.createDataFrame([(n, len(q.nodes) + k) for k, n in enumerate(q.names)] or [], "qualified_name string, first int")
    asked = by_id.withColumn("asked", F.col("node")).unionByName(atlas.nodes.select("node", "qualified_name").join(F.broadcast(by_name), "qualified_name").select("node", "first", F.col("node").alias("asked")))
    asked = asked.groupBy("node").agg(F.min("first").alias("first"))
    found = asked.join(atlas.nodes.select("node"), "node", "left_semi")
    found = ops.table(found.select("node", F.row_number().over(Window.orderBy("first", "node")).alias("place")), "anchors")  # ids of the request, and nodes of its names
    n = found.count()
    e = atlas.edges.select("edge_id", "src", "dst")
    near = e.select("edge_id", F.col("src").alias("anchor"), F.col("dst").alias("node")).unionByName(e.select("edge_id", F.col("dst").alias("anchor"), F.col("src").alias("node")))
    near = near.join(F.broadcast(found.select(F.col("node").alias("anchor"), "place")), "anchor").groupBy("anchor", "place", "node").agg(F.min("edge_id").alias("edge_id"))
    near = near.join(atlas.nodes.select("node"), "node", "left_semi")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("place").orderBy("edge_id"))).where(F.col("k") <= n * (q.limit + 1)).drop("k")
    rows = near.select("anchor", "place", "node", "edge_id").unionByName(found.select(F.col("node").alias("anchor"), "place", F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("edge_id")))
    admitted = ops.table(rows.coalesce(1).mapInPandas(partial(_greedy, limit=q.limit), "node string, at long"), "admitted")
    ids = found.select("node", F.col("place").alias("position")).unionByName(admitted.select("node", (F.col("at") + n + 1).cast("int").alias("position")))
    asked_for = asked.agg(F.count("*").alias("asked")).crossJoin(ids.agg(F.count("*").alias("in_context")))  # one row each
    matched = found.agg(F.count("*").alias("n"), F.lit(False).alias("truncated")).crossJoin(asked_for)
    return Answer(_shown(atlas, ids), matched, within(atlas.edges, ids), _of(atlas.metrics, ids), tests_of(atlas, ids), _of(atlas.signals, ids))


ANSWERS: dict[type[Request], Callable[[Atlas, Any], Answer]] = {
    Repository: _repository,
    Subsystem: _subsystem,
    Details: _details,
    Relation: _relation,
    Neighbourhood: _neighbourhood,
    Path: _path,
    Cycles: _cycles,
    Signals: _signals,
    Hotspots: _hotspots,
    Search: _search,
    Excerpt: _excerpt,
    Context: _context,
}


def run(atlas: Atlas, request: Request | dict[str, Any]) -> Answer:
    """The answer to a request, typed or as a mapping."""
    request = parse(request) if isinstance(request, dict) else request
    return ANSWERS[type(request)](atlas, request)


def run_plan(atlas: Atlas, requests: list[Request | dict[str, Any]]) -> list[Answer]:
    """Answers to at most ``MOST_REQUESTS`` requests; all are checked before the first is run."""
    if len(requests) > MOST_REQUESTS:
        raise RequestError(f"{len(requests)} requests; {MOST_REQUESTS} at most")
    typed = [parse(r) if isinstance(r, dict) else r for r in requests]
    return [run(atlas, r) for r in typed]


def flat(answer: Answer) -> DataFrame:
    """An answer as rows (section, position, id, detail, value): one shape for all kinds."""

    def rows(df: DataFrame, section: str, position: Column | None = None, ident: Column | None = None, detail: Column | None = None, value: Column | None = None) -> DataFrame:
        null = F.lit(None)
        return df.select(F.lit(section).alias("section"), (null if position is None else position).cast("long").alias("position"), (null if ident is None else ident).cast("string").alias("id"), (null if detail is None else detail).cast("string").alias("detail"), (null if value is None else value).cast("double").alias("value"))

    c, span = F.col, F.concat_ws(":", F.col("location.start_line"), F.col("location.end_line"))
    out = rows(answer.nodes, "node", c("position"), c("node"), F.concat_ws("|", "qualified_name", "node_type", "path", span, "is_public"))
    counts = [F.struct(F.lit(n).alias("k"), c(n).cast("double").alias("v")) for n in answer.matched.columns if n != "truncated"] + [F.struct(F.lit("truncated").alias("k"), c("truncated").cast("int").cast("double").alias("v"))]
    out = out.unionByName(rows(answer.matched.select(F.explode(F.array(*counts)).alias("c")), "matched", ident=c("c.k"), value=c("c.v")))
    if answer.edges is not None:
        out = out.unionByName(rows(answer.edges, "edge", None, c("edge_id"), F.concat_ws("|", "src", "dst", "edge_type")))
    if answer.metrics is not None:
        out = out.unionByName(rows(answer.metrics, "metric", c("rank") if "rank" in answer.metrics.columns else None, c("node"), c("metric"), c("value")))
    if answer.tests is not None:
        out = out.unionByName(rows(answer.tests, "test", None, c("node")))
    if answer.signals is not None:
        out = out.unionByName(rows(answer.signals, "signal", c("position"), c("node"), c("code")))
    if answer.excerpts is not None:
        out = out.unionByName(rows(answer.excerpts, "line", c("line"), None, c("text")))
    return out

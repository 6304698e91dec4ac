"""Graph operators on edge tables (src, dst): loops of joins, each round a table.

Reach is propagated in bits: 64 starts share one long, so a round joins and ors words instead of
pairs, counts are numbers of bits, and where only membership is asked one bit stands for all starts.
A round takes ``HOPS`` steps along edges before it is written. Chains of parents are followed by
doubling: a table of 1, 2, 4... hops.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lattica.functions.storage import ship, table
from lattica.operators.members import TASKS, every_pair

LOCAL = 500_000  # edges whose cycles one task contracts, at most about
WHOLE = 500_000  # edges of a graph that each task gets whole, at most
HOPS = 3  # steps of a round
LARGE = 250  # members of a component that meet those of another as a list


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) of all nodes that starts reach, by frontier rounds.

    A start isn't in its own result, even on a cycle. ``starts`` has a column start.
    """
    edges = edges.select("src", "dst").distinct()
    seen = table(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "seen")
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("start", F.col("node").alias("src")).join(edges, "src").select("start", F.col("dst").alias("node")).distinct()
        frontier = table(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = table(seen, "seen")
    return seen.where("node <> start")


class Condensed(NamedTuple):
    """Members (node, component, size) of strongly connected components, and the acyclic edges (src, dst) among these."""

    member: DataFrame
    between: DataFrame


def condense(edges: DataFrame) -> Condensed:
    """Components of all nodes of an edge; to be made once and passed on to what needs it."""
    edges = table(edges.select("src", "dst").distinct(), "edges")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    member = components(edges, ends)
    member = table(member.join(member.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size"), "members")
    a, b = (member.select(F.col("node").alias(end), F.col("component").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    between = edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return Condensed(member, table(between, "between"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _soonest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, near): a small name that each node reaches within some steps; nodes that reach the same mostly share it."""
    near = table(nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct().withColumn("near", F.col("node")), "near")
    back = edges.select(F.col("src").alias("to"), F.col("dst").alias("node"))
    for _ in range(2):
        rows = near
        for _ in range(HOPS):
            down = rows.join(back, "node").select(F.col("to").alias("node"), "near")
            rows = rows.unionByName(down).groupBy("node").agg(F.min("near").alias("near"))
        rows = table(rows, "near")
        near = rows.join(rows.select(F.col("node").alias("near"), F.col("near").alias("next")), "near").select("node", F.col("next").alias("near"))
    return nodes.select("node").join(near, "node")


def _placed(keys: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """``keys`` with a block and a place in it: 64 rows share a block, but for the last of each partition.

    Rows whose nodes (``by``) soon reach the same along ``edges`` lie side by side: what one place
    of a block reaches the others mostly reach too, so words are few and full.
    """
    near = _soonest(edges, keys.select(F.col(by).alias("node")).distinct())
    sorted_ = keys.join(near.withColumnRenamed("node", by), by).repartitionByRange("near", by).sortWithinPartitions("near", by)
    rows = table(sorted_.select(*keys.columns).withColumn("_at", F.monotonically_increasing_id()), "places")
    return rows.select(*keys.columns, F.shiftright("_at", 6).alias("block"), F.col("_at").bitwiseAND(F.lit(63)).alias("place"))


def spread_bits(edges: DataFrame, bits: DataFrame) -> DataFrame:
    """(node, block, bits): each node's own bits and those of all that reach it; rounds until nothing is new.

    ``bits`` has columns node, block and bits. Only bits that are new at a node go on from it.
    """
    near = edges.select(F.col("src").alias("node"), "dst")
    seen = table(bits.select("node", "block", "bits"), "bits")
    front = seen
    none = F.lit(0).cast("long")
    while True:
        wave, rows = front, seen.select("node", "block", F.col("bits").alias("known"), none.alias("last"))
        for k in range(HOPS):
            wave = wave.join(near, "node").groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
            known, last = (none, F.col("bits")) if k + 1 == HOPS else (F.col("bits"), none)
            rows = rows.unionByName(wave.select("node", "block", known.alias("known"), last.alias("last")))
        rows = rows.groupBy("node", "block").agg(F.bit_or("known").alias("known"), F.bit_or("last").alias("last"))
        fresh = F.col("last").bitwiseAND(F.bitwise_not("known"))  # bits that came sooner have gone on already
        rows = table(rows.select("node", "block", F.col("known").bitwiseOR(F.col("last")).alias("bits"), fresh.alias("fresh")), "bits")
        seen, front = rows.select("node", "block", "bits"), rows.where("fresh <> 0").select("node", "block", F.col("fresh").alias("bits"))
        if front.isEmpty():
            return seen


def _words(rows: DataFrame, by: str) -> DataFrame:
    """(node, block, bits) from rows (by, block, place)."""
    return rows.groupBy(F.col(by).alias("node"), "block").agg(F.bit_or(_bit(F.col("place"))).alias("bits"))


def closure(edges: DataFrame) -> DataFrame:
    """(start, node) for every node with an edge out; who is on a cycle isn't in its own result.

    Reach is found between components, whose members are put in last: lists of them meet, so no task
    makes all pairs of a large one, and no pair is shuffled or sorted.
    """
    member, between = condense(edges)
    place = _placed(member.select("component").distinct(), between, "component")
    reach = spread_bits(between, _words(place, "component"))
    each = reach.select("node", "block", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("place")).where(F.col("bits").bitwiseAND(_bit(F.col("place"))) != 0)
    pairs = each.join(place, ["block", "place"]).select(F.col("component").alias("a"), F.col("node").alias("b"))
    names = member.select(F.col("node").alias("name"), F.col("component").alias("of"))
    return every_pair(pairs, names, names, LARGE).select(F.col("a").alias("start"), F.col("b").alias("node")).where("start <> node")


def reach_counts(edges: DataFrame, parts: Condensed | None = None) -> DataFrame:
    """(node, forward, reverse, scc_size, component): how many nodes each reaches and is reached by, itself left out; size 0 and no component without a cycle."""
    member, between = parts or condense(edges)
    words = table(_words(_placed(member.select("node", "component"), between, "component"), "component"), "words")
    sides = (("reverse", between), ("forward", reverse(between)))
    out = member
    for name, along in sides:
        n = spread_bits(along, words).groupBy(F.col("node").alias("component")).agg((F.sum(F.bit_count("bits")) - 1).alias(name))
        out = out.join(n, "component")
    on_cycle = F.col("size") > 1
    return out.select("node", "forward", "reverse", F.when(on_cycle, F.col("size")).otherwise(0).alias("scc_size"), F.when(on_cycle, F.col("component")).alias("component"))


def reach_sums(edges: DataFrame, values: DataFrame, parts: Condensed | None = None) -> DataFrame:
    """(node, ...): the other columns of ``values`` (node, ...; whole numbers from 0) summed over each node and all that it reaches.

    A node that several ways reach counts once: sums are counts of bits, digit by binary digit of the
    values. Nulls count as 0; a node without an edge has its own values.
    """
    member, between = parts or condense(edges)
    names = [c for c in values.columns if c != "node"]
    values = table(values.select("node", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in names]), "values")
    most = values.agg(*[F.max(c) for c in names]).first()
    place = _placed(member.select("node", "component"), reverse(between), "component")
    reach = spread_bits(reverse(between), _words(place, "component"))
    digits = [(c, k) for c, m in zip(names, most) for k in range((m or 0).bit_length())]
    planes = [F.bit_or(F.when(F.col(c).bitwiseAND(F.lit(1 << k)) != 0, _bit(F.col("place"))).otherwise(F.lit(0).cast("long"))).alias(f"{c}_{k}") for c, k in digits]
    masks = place.join(values, "node").groupBy("block").agg(F.count("*").alias("_rows"), *planes)
    sums = [sum((F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col(f"{c}_{k}")))).cast("long") * F.lit(1 << k) for x, k in digits if x == c), F.lit(0).cast("long")).alias(c) for c in names]
    total = reach.join(masks, "block").groupBy(F.col("node").alias("component")).agg(*sums)
    linked = member.join(total, "component", "left").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    alone = values.join(member, "node", "left_anti")
    return linked.join(values.select("node"), "node", "left_semi").unionByName(alone)


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, target: str | None = None) -> DataFrame:
    """(start, node, path): of the shortest paths the smallest in the order of its nodes.

    Rounds end at ``max_depth``, when ``target`` is met, or when nothing new is.
    """
    edges = edges.select("src", "dst").distinct()
    seen = table(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0).alias("depth")).distinct(), "paths")
    frontier = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("start", F.col("node").alias("src"), "path").join(edges, "src")
        step = step.groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = table(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            break
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """One row (position, node) per node of the path from source to target; none if there is none."""
    spark = edges.sparkSession
    paths = shortest_paths(edges, spark.createDataFrame([(source,)], "start string"), max_depth, target).where(F.col("node") == target)
    return paths.select(F.posexplode("path").alias("position", "node"))


def neighbourhood(edges: DataFrame, start: str, depth: int, limit: int) -> DataFrame:
    """(position, node, depth): nodes within ``depth`` in breadth-first order, start left out."""
    paths = shortest_paths(edges, edges.sparkSession.createDataFrame([(start,)], "start string"), depth).where("depth > 0")
    top = paths.orderBy("depth", "path").limit(limit)
    return top.select("node", "depth", "path")


def _by_depth(edges: DataFrame, words: DataFrame, most: int) -> list[DataFrame]:
    """One table (node, block, bits) per depth from 0 to ``most`` or to the last with a row: the starts that have their shortest way there of that length."""
    near = edges.select(F.col("src").alias("node"), "dst")
    none = F.lit(0).cast("long")
    levels = [table(words.select("node", "block", "bits"), "level")]
    while len(levels) <= most:
        wave = levels[-1].join(near, "node").select(F.col("dst").alias("node"), "block", none.alias("known"), "bits")
        for level in levels:
            wave = wave.unionByName(level.select("node", "block", F.col("bits").alias("known"), none.alias("bits")))
        rows = wave.groupBy("node", "block").agg(F.bit_or("known").alias("known"), F.bit_or("bits").alias("bits"))
        rows = rows.select("node", "block", F.col("bits").bitwiseAND(F.bitwise_not("known")).alias("bits")).where("bits <> 0")
        level = table(rows, "level")
        if level.isEmpty():
            break
        levels.append(level)
    return levels


class Whole(NamedTuple):
    """A graph as arrays: names in order, and edges by numbers of these, in order of source and end."""

    names: list[str]
    src: np.ndarray
    dst: np.ndarray


def _whole(edges: pa.Table) -> Whole:
    src, dst = (edges.column(c).to_pylist() for c in ("src", "dst"))
    names = sorted({*src, *dst})
    at = {name: k for k, name in enumerate(names)}
    a, b = (np.array([at[name] for name in side], dtype=np.int64) for side in (src, dst))
    order = np.lexsort((b, a))
    return Whole(names, a[order], b[order])


def _paths(batches: Iterator[pa.RecordBatch], near: Whole, nodes: int) -> Iterator[pa.RecordBatch]:
    """(start, path) of the starts of this partition; 64 share a word per node and depth, and nothing else is kept."""
    names, src, dst = near
    back = np.argsort(dst, kind="stable")
    sources = src[back]
    ends, ends_at = np.unique(dst[back], return_index=True)
    begins, begins_at = np.unique(src, return_index=True)
    first = np.searchsorted(src, np.arange(len(names) + 1))

    def spread(bits: np.ndarray, along: np.ndarray, to: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), dtype=np.uint64)
        if len(to):
            out[to] = np.bitwise_or.reduceat(bits[along], at)
        return out

    def block(starts: list[str]) -> Iterator[list[str]]:
        at = [bisect_left(names, s) for s in starts]
        at = [k if k < len(names) and names[k] == s else None for k, s in zip(at, starts)]
        level = np.zeros(len(names), dtype=np.uint64)
        for i, k in enumerate(at):
            if k is not None:
                level[k] |= np.uint64(1 << i)
        seen, levels = level.copy(), [level]
        while len(levels) < nodes:
            level = spread(level, sources, ends, ends_at) & ~seen
            if not level.any():
                break
            seen |= level
            levels.append(level)
        alive = [np.bitwise_or.reduce(level) for level in levels] + [np.uint64(0)]
        for d in range(len(levels) - 1, 0, -1):
            wanted = alive[d] & ~alive[d + 1]
            levels[d] &= wanted if d + 1 == len(levels) else wanted | spread(levels[d + 1], dst, begins, begins_at)
        for i, (k, start) in enumerate(zip(at, starts)):
            path = [start]
            for level in levels[1:] if k is not None else []:
                next_ = dst[first[k] : first[k + 1]]
                on = np.flatnonzero(level[next_] & np.uint64(1 << i))
                if not len(on):
                    break
                k = next_[on[0]]
                path.append(names[k])
            yield path

    for batch in batches:
        starts = batch.column(0).to_pylist()
        paths = [path for k in range(0, len(starts), 64) for path in block(starts[k : k + 64])]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.string()), pa.array(paths, pa.list_(pa.string()))], names=["start", "path"])


def representative_paths(edges: DataFrame, starts: DataFrame, nodes: int = 20) -> DataFrame:
    """(start, path): of the breadth-first tree the longest path of at most so many nodes, ties to the smallest.

    Starts are bits: depth by depth the nodes that each reaches, then from the deepest back those on
    a shortest way to one. Only one path per start is ever written: at each depth its next node is the
    least that is marked. Depths of all pairs are written only for a graph of more than ``WHOLE``
    edges: a smaller one goes whole to each task, which does the same for its starts (see ``_paths``).
    """
    edges = table(edges.select("src", "dst").distinct(), "edges")
    if isinstance(edges.schema["src"].dataType, StringType) and edges.count() <= WHOLE:
        spark = edges.sparkSession
        ship(spark)
        near = spark.sparkContext.broadcast(_whole(edges.where("src is not null and dst is not null").toArrow()))
        dealt = starts.select("start").where("start is not null").distinct().repartition(TASKS * spark.sparkContext.defaultParallelism)
        return table(dealt.mapInArrow(lambda batches: _paths(batches, near.value, nodes), "start string, path array<string>"), "chain")
    place = _placed(starts.select("start").distinct(), edges, "start")
    levels = _by_depth(edges, _words(place, "start"), nodes - 1)
    alive = None
    for d, level in enumerate(levels):
        rows = level.groupBy("block").agg(F.bit_or("bits").alias("alive")).withColumn("depth", F.lit(d))
        alive = rows if alive is None else alive.unionByName(rows)
    alive = table(alive, "alive")
    marked = [levels[0]]
    for d in range(len(levels) - 1, 0, -1):
        further = alive.where(F.col("depth") == d + 1).select("block", F.col("alive").alias("further"))
        end = alive.where(F.col("depth") == d).join(further, "block", "left").select("block", F.col("alive").bitwiseAND(F.bitwise_not(F.coalesce("further", F.lit(0).cast("long")))).alias("wanted"))
        rows = levels[d].join(end, "block")
        if d + 1 < len(levels):
            on = marked[1].withColumnRenamed("node", "dst").join(edges, "dst").groupBy(F.col("src").alias("node"), "block").agg(F.bit_or("bits").alias("on"))
            rows = rows.join(on, ["node", "block"], "left").withColumn("wanted", F.col("wanted").bitwiseOR(F.coalesce("on", F.lit(0).cast("long"))))
        marked.insert(1, table(rows.select("node", "block", F.col("bits").bitwiseAND(F.col("wanted")).alias("bits")).where("bits <> 0"), "marked"))
    chain = place.select("start", "block", "place", F.col("start").alias("last"), F.array("start").alias("path"))
    for mark in marked[1:]:
        next_ = chain.select("start", "block", "place", F.col("last").alias("src")).join(edges, "src").withColumnRenamed("dst", "node").join(mark, ["node", "block"])
        next_ = next_.where(F.col("bits").bitwiseAND(_bit(F.col("place"))) != 0).groupBy("start").agg(F.min("node").alias("next"))
        path = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next")))
        chain = table(chain.join(next_, "start", "left").select("start", "block", "place", F.coalesce("next", "last").alias("last"), path.alias("path")), "chain")
    return chain.select("start", "path")


def _cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, name) of the nodes on a cycle of this partition's edges, named by the least of their component."""
    near: dict[str, list[str]] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            near.setdefault(a, []).append(b)
    order: dict[str, int] = {}
    path: list[str] = []  # open nodes
    heads: list[int] = []  # places in the path where an open component begins
    done: set[str] = set()
    out: list[tuple[str, str]] = []
    for root in near:
        if root in order:
            continue
        todo = [(root, iter(near[root]))]
        order[root] = len(path)
        heads.append(len(path))
        path.append(root)
        while todo:
            node, rest = todo[-1]
            for to in rest:
                if to not in order:
                    order[to] = len(path)
                    heads.append(len(path))
                    path.append(to)
                    todo.append((to, iter(near.get(to, ()))))
                    break
                if to not in done:
                    while heads[-1] > order[to]:
                        heads.pop()
            else:
                todo.pop()
                if heads[-1] == order[node]:
                    heads.pop()
                    members, path = path[order[node] :], path[: order[node]]
                    done.update(members)
                    if len(members) > 1:
                        least = min(members)
                        out += [(m, least) for m in members]
    for k in range(0, len(out), 50_000):
        part = out[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], pa.string()) for c in (0, 1)], names=["node", "name"])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest member.

    Cycles inside the edges of a task are contracted first: edges are dealt by ranges of the
    start's name, so what lies near by name meets, to as many tasks as the session runs at once, or
    more where each would hold more than ``LOCAL``. Rounds of ``_labelled`` find the cycles
    that cross tasks.
    """
    done = nodes.select("node").distinct().select("node", F.col("node").alias("component"))
    spark = edges.sparkSession
    open_ = table(edges.select("src", "dst").where("src <> dst").distinct(), "open")
    count = open_.count()
    if not count:
        return done
    ship(spark)
    dealt = open_.repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-count // LOCAL)), "src")
    local = table(dealt.mapInArrow(_cycles, "node string, name string"), "local")
    a, b = (local.select(F.col("node").alias(x), F.col("name").alias(f"{x}_name")) for x in ("src", "dst"))
    left = open_.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("src_name", "src").alias("src"), F.coalesce("dst_name", "dst").alias("dst"))
    over = _labelled(left.where("src <> dst").distinct())
    names = local
    if over is not None:
        over = table(over.select("node", F.col("name").alias("over")), "over")
        names = local.join(over.withColumnRenamed("node", "name"), "name", "left").select("node", F.coalesce("over", "name").alias("name"))
        names = names.unionByName(over.join(local, "node", "left_anti").select("node", F.col("over").alias("name")))
    return done.join(names.select("node", F.col("name").alias("found")), "node", "left").select("node", F.coalesce("found", "component").alias("component"))


DEGREE = 12  # bits of a label for the product of degrees, before those of a row's number


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start has an edge in and whose end has one out; others are on no cycle."""
    inner = edges
    for _ in range(2):
        ins, outs = inner.select(F.col("dst").alias("src")).distinct(), inner.select(F.col("src").alias("dst")).distinct()
        inner = inner.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst")
    return inner


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label): distinct longs, least for nodes with many edges in and out, which large cycles run through."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    most = (1 << DEGREE) - 1
    near = ends.groupBy("node").agg((F.lit(most) - F.least(F.sum("o") * F.sum("i"), F.lit(most))).alias("far"))
    rows = table(near.withColumn("at", F.monotonically_increasing_id()), "labels")
    return rows.select("node", (F.call_function("shiftleft", F.col("far"), F.lit(62 - DEGREE)).bitwiseOR(F.col("at"))).alias("label"))


def _least(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, node, name): the least node that reaches each along the edges (way, src, dst), itself included.

    A round takes ``HOPS`` steps and then the name of the name, which reaches the node as well, so
    long paths need few rounds.
    """
    names = table(nodes.select("way", "node", F.col("node").alias("name")), "names")
    near = edges.select("way", F.col("src").alias("node"), "dst")
    none = F.lit(None).cast("long")
    while True:
        rows, wave = names.select("way", "node", "name", F.col("name").alias("old")), names
        for _ in range(HOPS):
            wave = wave.join(near, ["way", "node"]).groupBy("way", F.col("dst").alias("node")).agg(F.min("name").alias("name"))
            rows = rows.unionByName(wave.select("way", "node", "name", none.alias("old")))
        rows = rows.groupBy("way", "node").agg(F.min("name").alias("name"), F.max("old").alias("old"))
        over = names.select("way", F.col("node").alias("name"), F.col("name").alias("over"))  # of the round before: known for every node
        rows = table(rows.join(over, ["way", "name"], "left").select("way", "node", F.least("name", F.coalesce("over", "name")).alias("name"), "old"), "names")
        names = rows.select("way", "node", "name")
        if rows.where("name <> old").isEmpty():
            return names


def _labelled(edges: DataFrame) -> DataFrame | None:
    """(node, name) of strongly connected components with an edge, named by their least node.

    Every open node learns the least label that reaches it and the least that it reaches, both
    in the same rounds. Where the two are one, that node's component is found. All nodes of a
    component agree in both, so edges between nodes that don't go; rounds end when none is left.
    """
    open_ = table(_trimmed(edges), "open")
    if open_.isEmpty():
        return None
    label = table(_labels(open_), "label")
    a, b = (label.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in ("src", "dst"))
    open_ = table(open_.join(a, "src").join(b, "dst").select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")), "open")
    found = None
    while True:
        both = open_.select(F.lit(0).alias("way"), "src", "dst").unionByName(open_.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst")))
        nodes = both.select("way", F.col("src").alias("node")).unionByName(both.select("way", F.col("dst").alias("node"))).distinct()
        names = _least(both, nodes)
        side = table(names.groupBy("node").agg(F.min(F.when(F.col("way") == 0, F.col("name"))).alias("into"), F.min(F.when(F.col("way") == 1, F.col("name"))).alias("out")), "sides")
        seen = side.where("into = out").select("node", F.col("into").alias("root"))
        found = seen if found is None else found.unionByName(seen)
        left = side.where("into <> out")
        a, b = (left.select(F.col("node").alias(x), F.col("into").alias(f"{x}_into"), F.col("out").alias(f"{x}_out")) for x in ("src", "dst"))
        same = open_.join(a, "src").join(b, "dst").where("src_into = dst_into and src_out = dst_out").select("src", "dst")
        open_ = table(_trimmed(same), "open")
        if open_.isEmpty():
            break
    named = found.join(label.select(F.col("label").alias("node"), F.col("node").alias("who")), "node").select("who", "root")
    least = named.groupBy("root").agg(F.min("who").alias("name"))
    return named.join(least, "root").select(F.col("who").alias("node"), "name")


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): undirected components, named by their smallest member; hooks and jumps of labels."""
    both = table(edges.select("src", "dst").unionByName(reverse(edges)).distinct(), "both")
    label = table(nodes.select("node", F.col("node").alias("component")).distinct(), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        new = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = table(new.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component"), "old"), "label")
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return label


def _longest(edges: DataFrame, seeds: DataFrame, name: str) -> DataFrame:
    """(node, name): greatest over a node and all that reach it of their seed (node, name) and the steps between.

    Of an acyclic graph. Only what rose in a round's last step goes on.
    """
    near = edges.select(F.col("src").alias("node"), "dst")
    known = table(seeds.select("node", F.col(name).cast("int").alias(name)), "longest")
    front = known
    none = F.lit(None).cast("int")
    while True:
        wave, rows = front, known.select("node", F.col(name).alias("known"), none.alias("last"))
        for k in range(HOPS):
            wave = wave.join(near, "node").groupBy(F.col("dst").alias("node")).agg((F.max(name) + 1).alias(name))
            sides = (none, F.col(name)) if k + 1 == HOPS else (F.col(name), none)
            rows = rows.unionByName(wave.select("node", sides[0].alias("known"), sides[1].alias("last")))
        rows = table(rows.groupBy("node").agg(F.max("known").alias("known"), F.max("last").alias("last")), "longest")
        known = rows.select("node", F.greatest("known", "last").alias(name))
        front = rows.where("last > coalesce(known, -1)").select("node", F.col("last").alias(name))
        if front.isEmpty():
            return known


def depths(edges: DataFrame, nodes: DataFrame, parts: Condensed | None = None) -> DataFrame:
    """(node, depth): the longest walk out of a node; the number of nodes where a cycle is reached."""
    all_ = nodes.select("node").distinct()
    n = all_.count()
    member, between = parts or condense(edges)
    back = reverse(between)
    cyclic = member.where("size > 1").select(F.col("component").alias("node"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("bits")).distinct()
    endless = table(spread_bits(back, cyclic).select("node"), "endless")
    calm = back.join(endless.withColumnRenamed("node", "dst"), "dst", "left_anti")  # who reaches an endless one is endless
    starts = calm.select(F.col("src").alias("node")).unionByName(calm.select(F.col("dst").alias("node"))).distinct().withColumn("depth", F.lit(0))
    level = _longest(calm, starts, "depth").unionByName(endless.withColumn("depth", F.lit(n))).withColumnRenamed("node", "component")
    return all_.join(member, "node", "left").join(level, "component", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): level(child) = level(parent) + 1 at least, from a column ``seed`` or 0; an error on a graph with a cycle."""
    edges = table(edges.select("src", "dst").distinct(), "edges")
    if not condense(edges).member.where("size > 1").isEmpty() or not edges.where("src = dst").isEmpty():
        raise ValueError("levels of a graph with a cycle")
    seed = F.col("seed") if "seed" in nodes.columns else F.lit(0)
    return _longest(edges, nodes.groupBy("node").agg(F.max(seed).alias("level")), "level")


class Chains(NamedTuple):
    """(node, end, hops, best) of chains along pointers, and the nodes that lie on a cycle."""

    ends: DataFrame
    cyclic: DataFrame | None


def _follow(pointers: DataFrame) -> Chains:
    """Follows pointers (node, parent, seed) to their end, by doubling: as many rounds as the longest chain has binary digits.

    ``best`` is the greatest of seed + hops over the node and what lies above it; without a pointer
    a node is its own end. A chain into a cycle ends at the first node of the cycle that it meets.
    """
    rows = table(pointers.select("node", "parent", F.col("seed").cast("long").alias("seed")), "pointers")
    n, cyclic = rows.count(), None
    while True:
        up = F.col("parent") if cyclic is None else F.when(F.col("ring").isNull(), F.col("parent"))
        here = rows if cyclic is None else rows.join(cyclic.select("node", F.lit(True).alias("ring")), "node", "left")
        state = table(here.select("node", up.alias("to"), F.col("seed").alias("best"), F.lit(1).cast("long").alias("span")), "chain")
        span = 1
        while True:
            above = state.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("best").alias("above"), F.col("span").alias("more"))
            step = state.join(above, "to", "left")
            rise = F.when(F.col("above").isNotNull(), F.greatest("best", F.col("above") + F.col("span"))).otherwise(F.col("best"))
            goes = F.col("next").isNotNull()
            state = table(step.select("node", F.coalesce("next", "to").alias("to"), rise.alias("best"), F.when(goes, F.col("span") + F.col("more")).otherwise(F.col("span")).alias("span"), goes.alias("goes")), "chain")
            span *= 2
            open_ = state.where("goes")
            if open_.isEmpty():
                ends = state.select("node", F.coalesce("to", "node").alias("end"), F.when(F.col("to").isNull(), 0).otherwise(F.col("span")).alias("hops"), "best")
                return Chains(ends, cyclic)
            if span > 2 * n:  # longer than any chain: these are all on cycles or lead into one
                cyclic = table(open_.select(F.col("to").alias("node")).distinct(), "cyclic")
                break
            state = state.drop("goes")


def _pointers(nodes: DataFrame) -> DataFrame:
    """One row (node, parent) per node; of several parents the least, of parents that are no node none."""
    own = nodes.groupBy("node").agg(F.min("parent").alias("parent"))
    there = own.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    return own.join(there, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent"))


def tree_levels(nodes: DataFrame) -> DataFrame:
    """(node, level) of a tree of parents (node, parent, and a column ``seed`` or 0): level(child) = level(parent) + 1 at least.

    An error where parents form a cycle.
    """
    seed = nodes.groupBy("node").agg(F.max("seed" if "seed" in nodes.columns else F.lit(0)).alias("seed"))
    rows = _pointers(nodes).join(seed, "node", "left").select("node", "parent", F.coalesce("seed", F.lit(0)).alias("seed"))
    ends, cyclic = _follow(rows)
    if cyclic is not None:
        raise ValueError("levels of a graph with a cycle")
    return nodes.select("node").distinct().join(ends, "node").select("node", F.col("best").alias("level"))


def ancestors(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, ancestor, distance) along parent pointers, the nearest ``limit`` or all; a cycle ends a chase before the node itself.

    Doubling: a node's ancestors of up to 2k hops are its own of k and those of its k-th.
    """
    jump = table(nodes.select("node", F.col("parent").alias("to")).where("to is not null and to <> node").distinct(), "jump")
    out, k = jump.select("node", F.col("to").alias("ancestor"), F.lit(1).alias("distance")), 1
    while limit is None or k < limit:
        far = jump.join(out.select(F.col("node").alias("to"), "ancestor", "distance"), "to").where("node <> ancestor")
        far = far.groupBy("node", "ancestor").agg((F.min("distance") + k).alias("distance")).join(out.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        far = table(far, "ancestors")
        if far.isEmpty():
            break
        out = out.unionByName(far)
        jump = table(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")), "jump")
        k *= 2
    return out if limit is None else out.where(F.col("distance") <= limit)


def descendants(contains: DataFrame, start: str, limit: int) -> DataFrame:
    """(node, depth, path) under start in breadth-first order; cut after the whole walk."""
    paths = shortest_paths(contains, contains.sparkSession.createDataFrame([(start,)], "start string")).where("depth > 0")
    return paths.orderBy("depth", "path").limit(limit).select("node", "depth")


def top_container(nodes: DataFrame, root_types: list[str]) -> DataFrame:
    """(node, cluster): the topmost container below a root, or the node itself; on a cycle of containers the first that is met again."""
    kind = nodes.groupBy("node").agg(F.max(F.coalesce(F.col("node_type").isin(root_types), F.lit(False))).alias("root"))
    own = _pointers(nodes).join(kind, "node", "left")
    above = kind.select(F.col("node").alias("parent"), F.col("root").alias("above"))
    below = F.coalesce("root", F.lit(False)) | F.coalesce("above", F.lit(False))
    rows = own.join(above, "parent", "left").select("node", F.when(~below, F.col("parent")).alias("parent"), F.lit(0).alias("seed"))
    return nodes.select("node").join(_follow(rows).ends, "node").select("node", F.col("end").alias("cluster"))


def crossings(paths: DataFrame, owner: DataFrame) -> DataFrame:
    """(start, crossings): hops of a path whose ends have different owners, one of them at least not null."""
    pairs = F.zip_with(F.expr("slice(path, 1, size(path) - 1)"), F.expr("slice(path, 2, size(path) - 1)"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hops = paths.select("start", F.explode(pairs).alias("hop"))
    a = owner.select(F.col("node").alias("a"), F.col("owner").alias("owner_a"))
    b = owner.select(F.col("node").alias("b"), F.col("owner").alias("owner_b"))
    hops = hops.select("start", "hop.a", "hop.b").join(a, "a", "left").join(b, "b", "left")
    n = hops.groupBy("start").agg(F.sum(F.when(~F.col("owner_a").eqNullSafe(F.col("owner_b")), 1).otherwise(0)).alias("crossings"))
    return paths.select("start").join(n, "start", "left").select("start", F.coalesce("crossings", F.lit(0)).alias("crossings"))

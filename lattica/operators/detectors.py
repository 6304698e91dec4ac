"""Structural patterns over nodes, edges and module facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.members import TASKS
from lattica.operators.overlap import overlap_groups, overlap_pairs
from lattica.operators.structure import foreign_owners

LARGE = 1_000  # rows of a component that meet all its members' names at once


def dependants(edges: DataFrame) -> DataFrame:
    """(node, dependants): rows, not distinct sources, of dependency edges per target."""
    kinds = ("IMPORTS", "REFERENCES", "CALLS")
    return edges.where(F.col("edge_type").isin(*kinds)).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependants"))


def sole_implementation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Interfaces with exactly one distinct, existing implementor that is no interface itself."""
    kind = nodes.select("node", "node_type")
    impl = edges.where(F.col("edge_type").isin("IMPLEMENTS", "INHERITS")).select("src", "dst").distinct()
    impl = impl.join(kind.where("node_type <> 'INTERFACE'").select(F.col("node").alias("src")), "src", "left_semi")
    impl = impl.join(kind.where("node_type = 'INTERFACE'").select(F.col("node").alias("dst")), "dst", "left_semi")
    one = impl.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("implementation")).where("n = 1").drop("n")
    return one.join(dependants(edges), "node", "left").select("node", "implementation", F.coalesce("dependants", F.lit(0)).alias("dependants"))


def duplicated_knowledge(constants: DataFrame) -> DataFrame:
    """Names (module, name, fingerprint) that two distinct modules state: how often, with how many values."""
    some = F.when(F.col("fingerprint") != "", F.col("fingerprint"))
    out = constants.groupBy("name").agg(
        F.countDistinct("module").alias("modules"), F.count("*").alias("modules_stating_it"), F.countDistinct(some).alias("distinct_values"), F.countDistinct("fingerprint").alias("_all")
    )
    return out.where("modules >= 2").select("name", "modules", "modules_stating_it", "distinct_values", ((F.col("_all") == 1) & (F.col("distinct_values") == 1)).alias("agreed"))


def duplicate_signal(constants: DataFrame) -> DataFrame:
    """Every statement of a name that is stated twice or more."""
    n = constants.groupBy("name").agg(F.count("*").alias("stated")).where("stated >= 2")
    return constants.join(n, "name").select("name", "module", "fingerprint", "stated")


def scattered_concept(owners: DataFrame, mentions: DataFrame, least: int) -> DataFrame:
    """Owners (owner, package, stem) whose stem modules outside their package mention (path, stem), so many at least."""
    outside = mentions.join(owners, "stem").where((F.col("path") != F.col("package")) & ~F.startswith("path", F.concat("package", F.lit("/"))))
    return outside.groupBy("owner", "stem").agg(F.countDistinct("path").alias("modules")).where(F.col("modules") >= least)


def scattered_concepts(owners: DataFrame, words: DataFrame, mentions: DataFrame, least: int) -> DataFrame:
    """(owner, stem, abstraction, modules): owners of a foreign abstraction whose stem many modules outside their package mention.

    owners: owner, package, stem, abstraction; words: abstraction, word; mentions: path, stem. Foreign
    means that no word of the abstraction begins like the stem. Modules are counted per stem and
    package once, not per owner: outside of a package are all but those in it.
    """
    own = owners.select("owner", "stem", "abstraction", "package")
    foreign = own.join(foreign_owners(owners, words).select("owner"), "owner", "left_semi")
    m = mentions.select("path", "stem").distinct().join(foreign.select("stem").distinct(), "stem", "left_semi")
    all_ = m.groupBy("stem").agg(F.count("*").alias("all_modules"))
    asked = foreign.select("stem", "package").distinct()
    inside = m.join(asked, "stem").where((F.col("path") == F.col("package")) | F.startswith("path", F.concat("package", F.lit("/"))))
    inside = inside.groupBy("stem", "package").agg(F.count("*").alias("inside"))
    out = foreign.join(all_, "stem").join(inside, ["stem", "package"], "left")
    modules = F.col("all_modules") - F.coalesce("inside", F.lit(0))
    return out.select("owner", "stem", "abstraction", modules.alias("modules")).where(F.col("modules") >= least)


def dependant_packages(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """(node, packages, n): distinct packages of direct dependants other than the node's own."""
    d = edges.select("src", "dst").distinct().join(parent.select(F.col("node").alias("src"), F.col("parent").alias("package")), "src")
    d = d.join(parent.select(F.col("node").alias("dst"), F.col("parent").alias("own")), "dst").where(F.col("package") != F.col("own"))
    return d.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("package")), ",").alias("packages"), F.countDistinct("package").alias("n_packages"))


def concentrated_scope(profile: DataFrame, symbols: int, packages: int, affected: int) -> DataFrame:
    """Modules at or above all three thresholds."""
    return profile.where((F.col("public_symbols") >= symbols) & (F.col("n_packages") >= packages) & (F.col("affected") >= affected))


def parallel_pairs(features: DataFrame, least: int = 4, overlap: float = 0.6) -> DataFrame:
    """(a, b, shared): pairs of items (item, feature) of which the smaller shares so many features and that share of its own."""
    return overlap_pairs(features, least, overlap).select("a", "b", F.size("shared").cast("long").alias("shared"))


def parallel_groups(features: DataFrame, least: int = 4, overlap: float = 0.6) -> DataFrame:
    """(role, a, b, shared): ``parallel_pairs`` of items that are alike, without a row for every pair of copies.

    Rows ``pair`` hold two items that stand for those of the same features, or one with itself where
    it stands for others; rows ``member`` each item of ``least`` features (a), what stands for it (b)
    and the number of its features. See ``overlap_groups``.
    """
    pairs, members = overlap_groups(features, least, overlap)
    out = pairs.select(F.lit("pair").alias("role"), "a", "b", F.col("n_shared").cast("long").alias("shared"))
    return out.unionByName(members.select(F.lit("member").alias("role"), F.col("item").alias("a"), F.col("of").alias("b"), F.col("size").alias("shared")))


def folder_rollup(files: DataFrame, path: str, size: str, levels: int = 2) -> DataFrame:
    """(folder, files, bytes): each file counts in its first ``levels`` ancestor folders; a file in none, nowhere."""
    parts = F.split(path, "/")
    depth = F.least(F.size(parts) - 1, F.lit(levels))
    at = F.when(depth >= 1, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    rows = files.select(parts.alias("parts"), F.col(size).alias("bytes"), F.explode(at).alias("k"))
    folder = F.array_join(F.expr("slice(parts, 1, k)"), "/").alias("folder")
    return rows.groupBy(folder).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def excluded(files: DataFrame, path: str, prefixes: list[str]) -> DataFrame:
    """Files outside all prefixes, compared by path parts."""
    for p in prefixes:
        if p.startswith("/") or "\\" in p or ".." in p.split("/"):
            raise ValueError(f"no relative folder: {p}")
        files = files.where(~((F.col(path) == p) | F.col(path).startswith(p.rstrip("/") + "/")))
    return files


#: folders that a review can often do without (fixed values)
SUGGESTED = ["tests", "test", "testing", "docs", "doc", "examples", "example", "benchmarks", "benchmark", "samples", "sample", "demos", "demo"]


def folder_tree(files: DataFrame, path: str, size: str, levels: int = 2) -> tuple[DataFrame, DataFrame]:
    """(folder, files, bytes, suggested) in order of folders, and the totals (files, bytes) of all files, each once."""
    rows = folder_rollup(files, path, size, levels)
    named = F.element_at(F.split("folder", "/"), -1).isin(SUGGESTED)
    totals = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return rows.withColumn("suggested", named).orderBy("folder"), totals


def content_fingerprint(files: DataFrame, path: str, content: Column) -> DataFrame:
    """One row: a hash of all paths and contents, whatever the order of rows.

    A tree of hashes: files go to 65,536 leaves by a hash of their path, these to 256 branches, so
    a row holds the hashes of a small share of the files.
    """
    at = F.sha2(F.col(path).cast("string"), 256)
    rows = files.select(at.alias("at"), F.sha2(F.concat_ws("\0", F.col(path).cast("string"), F.sha2(content, 256)), 256).alias("h"))
    for digits in (4, 2, 0):
        group = F.substring("at", 1, digits) if digits else F.lit("")
        rows = rows.groupBy(group.alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\0"), 256).alias("h"))
    return rows.select(F.col("h").alias("fingerprint"))


def visible(nodes: DataFrame, edges: DataFrame, kinds: list[str], tests: bool, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the kinds that aren't private (unknown counts as public), and edges among them without loops."""
    rule = F.col("node_type").isin(kinds) & ~F.col("is_public").eqNullSafe(False)
    if not tests:
        rule &= F.col("node_type") != "TEST"
    shown = nodes.where(rule | F.col("node").isin(kept))
    ids = shown.select("node")
    inner = edges.where("src <> dst").join(ids.select(F.col("node").alias("src")), "src", "left_semi").join(ids.select(F.col("node").alias("dst")), "dst", "left_semi")
    return shown, inner


def cycle_signals(component: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, members, size, first_edge) of the members of components of two or more: all members' names, joined by commas, and the first edge by id that stays inside.

    All members' names are as long as the component is large, so they are not joined or shuffled with
    its rows: lists of these meet them, dealt to many tasks, and rows are put out last.
    """
    size = component.groupBy("component").agg(F.count("*").alias("size")).where("size >= 2")
    big = component.join(size, "component").select("node", "component", "size")
    own = big.select("node", "component")
    inside = edges.join(own.withColumnRenamed("node", "src"), "src").join(own.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    first = inside.groupBy(F.col("src").alias("node")).agg(F.min("edge_id").alias("first_edge"))
    parts = F.ceil(F.col("size") / LARGE)
    rows = big.join(first, "node", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts))
    lists = rows.groupBy("component", "part").agg(F.collect_list(F.struct("node", "size", "first_edge")).alias("rows"))
    dealt = lists.repartition(TASKS * component.sparkSession.sparkContext.defaultParallelism, "component", "part")
    names = F.array_join(F.array_sort(F.collect_list("node")), ",")
    members = big.groupBy("component", "size").agg(names.alias("members"))
    members = members.select("component", "members", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    each = dealt.join(members, ["component", "part"]).select("component", "members", F.explode("rows").alias("row"))
    return each.select("row.node", "component", "members", "row.size", "row.first_edge")

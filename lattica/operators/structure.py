"""Conformance, parallel preparation, broad inputs, tests of a selection, clusters: joins over operations and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import table
from lattica.operators import graph
from lattica.operators.members import every_pair
from lattica.operators.overlap import overlap_groups, overlap_pairs

#: annotations whose spelling is comparable (fixed values)
BUILTINS = ["bool", "bytes", "complex", "dict", "float", "frozenset", "int", "list", "None", "set", "str", "tuple"]
LARGE = 250  # alike classes or interfaces of a list


def conformance(wanted: DataFrame, offered: DataFrame, known: DataFrame) -> DataFrame:
    """(class, interface, operations, agreements): classes with all operations of an interface they don't declare.

    wanted: interface, operation, is_async, arity, annotations (array, "" where none; the last is
    the return's). offered: class, operation and the same columns. known: class, interface that
    already are implementations. A class must have all operations, so it meets an interface on the one
    of these that fewest classes offer in that shape, and what met is held against the others: a name
    that all classes share brings none together unless an interface has nothing else. Two
    built-in annotations that differ contradict; with a single operation, two annotations must agree.
    """
    shape = ["operation", "is_async", "arity"]
    wanted = wanted.dropDuplicates(["interface", "operation"])
    offered = offered.dropDuplicates(["class", "operation"]).select("class", *shape, F.col("annotations").alias("own_annotations"))
    often = wanted.select("interface", *shape).join(offered.groupBy(*shape).agg(F.count("*").alias("n")), shape, "left")
    total = often.groupBy("interface").agg(F.count("*").alias("operations"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), *shape)).alias("rare"))
    rare = total.where("rare.n > 0").select("interface", "operations", *[F.col(f"rare.{c}").alias(c) for c in shape])
    met = rare.join(offered.select("class", *shape), shape).select("interface", "operations", "class")
    met = met.join(known.select("class", "interface"), ["class", "interface"], "left_anti")
    both = F.arrays_zip(F.col("annotations").alias("x"), F.col("own_annotations").alias("y"))
    against = F.exists(both, lambda p: (p["x"] != "") & (p["y"] != "") & (p["x"] != p["y"]) & p["x"].isin(BUILTINS) & p["y"].isin(BUILTINS))
    agree = F.size(F.filter(both, lambda p: (p["x"] != "") & (p["x"] == p["y"])))
    all_ = met.join(wanted.select("interface", *shape, "annotations"), "interface").join(offered, ["class", *shape]).where(~against)
    found = all_.groupBy("class", "interface", "operations").agg(F.count("*").alias("matched"), F.sum(agree).alias("agreements"))
    return found.where("matched = operations and (operations >= 2 or agreements >= 2)").select("class", "interface", "operations", "agreements")


def conforming_groups(wanted: DataFrame, offered: DataFrame, known: DataFrame) -> DataFrame:
    """(role, name, of, operations, agreements): ``conformance`` of classes and interfaces that are alike, without a row for every pair of copies.

    Rows ``pair`` hold a class (name) and an interface (of) that stand for those like them; rows
    ``class`` and ``interface`` hold each member of these (name) and what stands for it (of).
    Members of a pair's sides conform each with each: alike are classes of the same operations that
    declare the same interfaces, and interfaces of the same operations that no class declares.
    """
    shape = ["operation", "is_async", "arity", "annotations"]
    wanted = table(wanted.dropDuplicates(["interface", "operation"]), "wanted")
    offered = table(offered.dropDuplicates(["class", "operation"]), "offered")
    known = table(known.select("class", "interface").distinct(), "known")
    looks = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*shape)))), 256).alias("looks")

    def standing(rows: DataFrame, name: str, declared: DataFrame) -> DataFrame:
        each = rows.groupBy(name).agg(looks).join(declared, name, "left").withColumn("declared", F.coalesce("declared", F.lit("")))
        first = each.groupBy("looks", "declared").agg(F.min(name).alias("of"))
        return table(each.join(first, ["looks", "declared"]).select(name, "of"), "standing")

    its = known.groupBy("class").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("interface"))), 256).alias("declared"))
    classes = standing(offered, "class", its)
    interfaces = standing(wanted, "interface", known.select("interface", F.col("interface").alias("declared")).distinct())
    alone = [side.where(F.col(name) == F.col("of")).select(name) for side, name in ((interfaces, "interface"), (classes, "class"))]
    pairs = table(conformance(wanted.join(alone[0], "interface", "left_semi"), offered.join(alone[1], "class", "left_semi"), known), "conforming")
    out = pairs.select(F.lit("pair").alias("role"), F.col("class").alias("name"), F.col("interface").alias("of"), "operations", "agreements")
    for side, name in ((classes, "class"), (interfaces, "interface")):
        members = side.join(pairs.select(F.col(name).alias("of")).distinct(), "of", "left_semi")
        out = out.unionByName(members.select(F.lit(name).alias("role"), F.col(name).alias("name"), "of", F.lit(None).cast("long").alias("operations"), F.lit(None).cast("long").alias("agreements")))
    return out


def conforming_pairs(wanted: DataFrame, offered: DataFrame, known: DataFrame) -> DataFrame:
    """(class, interface, operations, agreements): ``conformance``, found for what stands for those alike and put out for each of these."""
    rows = table(conforming_groups(wanted, offered, known), "conforming")
    pairs = rows.where("role = 'pair'").select(F.col("name").alias("a"), F.col("of").alias("b"), "operations", "agreements")
    sides = [rows.where(F.col("role") == role).select("name", "of") for role in ("class", "interface")]
    return every_pair(pairs, *sides, LARGE).select(F.col("a").alias("class"), F.col("b").alias("interface"), "operations", "agreements")


def conformance_questions(interfaces: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """(interface, class): pairs that share an operation's name and aren't known; the others can't conform.

    interfaces: interface, operation; classes: class, operation. An interface without operations asks nothing.
    """
    pairs = interfaces.select("interface", "operation").distinct().join(classes.select("class", "operation").distinct(), "operation")
    return pairs.select("interface", "class").distinct().join(known.select("class", "interface"), ["class", "interface"], "left_anti").select("interface", "class")


def parallel_preparation(methods: DataFrame, features: DataFrame, least: int = 4, overlap: float = 0.6) -> DataFrame:
    """(a, b, paths, keys): methods of one operation that prepare the same input.

    methods: port, operation, method. features: method, kind (path or key), feature. Of a pair the
    smaller has ``least`` features, as many are shared, and that share of its own; three shared
    are paths, or one is and three are keys. Methods meet inside their operation, on their
    rarest features (see ``overlap``).
    """
    named = features.select("method", F.struct("kind", "feature").alias("feature"))
    rows = methods.select("port", "operation", "method").join(named, "method").withColumnRenamed("method", "item")
    of = lambda kind: F.size(F.filter("shared", lambda f: f["kind"] == kind)).cast("long").alias(f"{kind}s")
    met = overlap_pairs(rows, least, overlap, ["port", "operation"]).select("a", "b", of("path"), of("key"))
    return met.where(PREPARED).distinct()


PREPARED = "paths >= 3 or paths >= 1 and keys >= 3"


def preparation_groups(methods: DataFrame, features: DataFrame, least: int = 4, overlap: float = 0.6) -> DataFrame:
    """(role, port, operation, a, b, paths, keys): ``parallel_preparation`` of methods that are alike, without a row for every pair of copies.

    Rows ``pair`` hold two methods that stand for those of the same features in their operation; a
    pair of one with itself says that those which it stands for are pairs. Rows ``member`` hold
    each method of ``least`` features (a) and the one that stands for it (b). See ``overlap_groups``.
    """
    owners = methods.select("port", "operation", F.col("method").alias("item"))
    rows = features.select(F.col("method").alias("item"), F.struct("kind", "feature").alias("feature"))
    kinds = {"paths": lambda f: f["kind"] == "path", "keys": lambda f: f["kind"] == "key"}
    pairs, members = overlap_groups(rows, least, overlap, ["port", "operation"], owners, kinds)
    none = F.lit(None).cast("long")
    out = pairs.where(PREPARED).select(F.lit("pair").alias("role"), "port", "operation", "a", "b", "paths", "keys")
    return out.unionByName(members.select(F.lit("member").alias("role"), "port", "operation", F.col("item").alias("a"), F.col("of").alias("b"), none.alias("paths"), none.alias("keys")))


def broad_inputs(fields: DataFrame) -> DataFrame:
    """(item, root, paths, keys): roots (first two parts of a path) of which an item takes much.

    fields: item, key, path. Items with three keys or more; of a root three distinct paths of
    three parts or more, and two keys that come from them.
    """
    f = fields.select("item", "key", "path").distinct()
    many = f.groupBy("item").agg(F.countDistinct("key").alias("n")).where("n >= 3").select("item")
    parts = F.split("path", "[.]")
    deep = f.join(many, "item", "left_semi").where(F.size(parts) >= 3).withColumn("root", F.concat_ws(".", parts[0], parts[1]))
    return deep.groupBy("item", "root").agg(F.countDistinct("path").alias("paths"), F.countDistinct("key").alias("keys")).where("paths >= 3 and keys >= 2")


def associated_tests(nodes: DataFrame, edges: DataFrame, selection: DataFrame) -> DataFrame:
    """(node): selected test nodes, and sources of TESTS edges into the selection."""
    chosen = selection.select("node").distinct()
    own = nodes.where(F.col("node_type").startswith("TEST")).select("node").join(chosen, "node", "left_semi")
    by_edge = edges.where("edge_type = 'TESTS'").join(chosen.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return own.unionByName(by_edge).distinct().orderBy("node")


def owners_of_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(src, dst, src_owner, dst_owner): the owning module of both ends, by the path of each."""
    a, b = (owner.select(F.col("node").alias(x), F.col("owner").alias(f"{x}_owner")) for x in ("src", "dst"))
    return edges.select("src", "dst").join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "src_owner", "dst_owner")


def foreign_owners(owners: DataFrame, words: DataFrame) -> DataFrame:
    """Owners (owner, stem, abstraction) whose stem begins like no word of the abstraction: no four letters in common."""
    w = words.where(F.length("word") >= 4).select("abstraction", F.lower(F.substring("word", 1, 4)).alias("start")).distinct()
    return owners.withColumn("start", F.lower(F.substring("stem", 1, 4))).join(w, ["abstraction", "start"], "left_anti").select("owner", "stem", "abstraction")


def centre_clusters(edges: DataFrame, nodes: DataFrame, most: int = 6, far: int = 1000) -> DataFrame:
    """(node, seed, distance): nearest of k seeds, k = round(sqrt(n / 4)) between 1 and ``most``.

    The first seed is the node with most neighbours (ties: least name), each further one the node
    farthest from all before it. Distances go both ways along edges; ``far`` where there is no way.
    One breadth-first search per seed, so ``most`` of them.
    """
    n = nodes.select("node").distinct().count()
    if not n:
        return nodes.select("node").withColumn("seed", F.col("node")).withColumn("distance", F.lit(0)).limit(0)
    both = table(edges.select("src", "dst").unionByName(graph.reverse(edges)).where("src <> dst").distinct(), "both")
    k = int(min(max(round((n / 4) ** 0.5), 1), most))
    degree = nodes.select("node").distinct().join(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")), "node", "left")
    seed = degree.orderBy(F.coalesce("d", F.lit(0)).desc(), "node").first()[0]
    near = nodes.select("node").distinct().withColumn("seed", F.lit(None).cast("string")).withColumn("distance", F.lit(None).cast("int"))
    for _ in range(k):
        start = both.sparkSession.createDataFrame([(seed,)], "start string")
        walk = graph.reachable(both, start).select("node", "depth").unionByName(start.select(F.col("start").alias("node"), F.lit(0).alias("depth")))
        new = F.coalesce("depth", F.lit(far))
        closer = F.col("distance").isNull() | (new < F.col("distance"))
        near = table(near.join(walk, "node", "left").select("node", F.when(closer, F.lit(seed)).otherwise(F.col("seed")).alias("seed"), F.when(closer, new).otherwise(F.col("distance")).alias("distance")), "near")
        top = near.orderBy(F.col("distance").desc(), "node").first()
        if top["distance"] == 0:
            break
        seed = top["node"]
    return near


def cycle_members(component: DataFrame, least: int = 2) -> DataFrame:
    """(component, position, node, size) of components of ``least`` nodes: one row per member, none holds them all."""
    big = component.join(component.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least), "component")
    return big.withColumn("position", F.row_number().over(Window.partitionBy("component").orderBy("node"))).select("component", "position", "node", "size")

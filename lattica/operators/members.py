"""Pairs of members, from pairs of what stands for them: lists of bounded length meet, and only these are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASKS = 4  # tasks a core that pairs of lists are dealt to


def listed(members: DataFrame, most: int) -> DataFrame:
    """(of, part, names): ``members`` (name, of) in lists of about ``most`` names, so no row holds a large class."""
    size = members.groupBy("of").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("name"), F.ceil(F.col("size") / most)).alias("part")
    return members.join(size, "of").groupBy("of", part).agg(F.collect_list("name").alias("names"))


def every_pair(pairs: DataFrame, left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """``pairs`` (a, b and others) with a row for each member (name, of) of a in ``left`` and of b in ``right``.

    The pairs of two large classes are more rows than a task should make or a shuffle hold: tasks get
    pairs of lists, by the list of b, and members are put out last.
    """
    spark = pairs.sparkSession
    others = [c for c in pairs.columns if c not in ("a", "b")]
    a = listed(left, most).select(F.col("of").alias("a"), F.col("names").alias("lefts"))
    b = listed(right, most).select(F.col("of").alias("b"), "part", F.col("names").alias("rights"))
    met = pairs.join(a, "a").join(b.select("b", "part"), "b").select("b", "part", "lefts", *others)
    dealt = met.repartition(TASKS * spark.sparkContext.defaultParallelism, "b", "part").join(b, ["b", "part"])
    each = dealt.select(F.explode("lefts").alias("a"), "rights", *others)
    return each.select("a", F.explode("rights").alias("b"), *others)

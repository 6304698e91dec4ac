"""Exact quantiles of groups by refined histograms: no task and no buffer holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import table

BINS = 4096  # rows of a histogram, at most


def quantiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(group..., n, names of ``at``): quantiles of the finite values per group, on a line between the two next to a place.

    Each place of each group has an interval of values that holds it, first all of them. A pass counts
    the values of the interval in ``BINS`` bins, with partial sums, and goes on with the least and
    greatest value of the bin that holds the place; passes end when all intervals are one value. Least
    and greatest fall in different bins, so each pass leaves fewer values, and two or three
    are enough for most. Nulls and NaN don't count, nor do rows whose group is null; a group without
    values has no row.
    """
    v = F.col(value).cast("double")
    own = table(rows.select(*group, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "values")
    size = own.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    places = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(p))).alias("place")) for name, p in at.items()])
    asked = size.select(*group, "n", "lo", "hi", F.explode(places).alias("p"))
    ends = F.array_distinct(F.array(F.floor("p.place"), F.ceil("p.place")))
    asked = table(asked.select(*group, "n", "p.name", "p.place", "lo", "hi", F.explode(ends).alias("k")).withColumn("left", F.col("k")), "places")
    keys = [*group, "name", "k"]
    found, open_ = asked.where("lo = hi"), asked.where("lo < hi")
    while not open_.isEmpty():
        near = open_.select(*keys, "lo", "hi")
        inside = own.join(near, group) if group else own.crossJoin(F.broadcast(near))  # without groups, a row per place
        inside = inside.where("v between lo and hi")
        width = F.col("hi") / 2 - F.col("lo") / 2
        bin_ = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BINS), F.lit(BINS - 1))
        counts = inside.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        step = counts.withColumn("before", before).join(open_.drop("lo", "hi"), keys).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("m")))
        step = table(step.select(*group, "n", "name", "place", F.col("low").alias("lo"), F.col("high").alias("hi"), "k", (F.col("left") - F.col("before")).alias("left")), "places")
        found, open_ = found.unionByName(step.where("lo = hi")), step.where("lo < hi")
    low, high = F.min_by("lo", "k"), F.max_by("lo", "k")
    value_at = low + (high - low) * (F.first("place") - F.min("k"))
    got = found.groupBy(*group, "n", "name").agg(value_at.alias("q"))
    return got.groupBy(*group, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at])

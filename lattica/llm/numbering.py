"""Gapless numbers in a total order, without a window over all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import table

_AT, _PART = "_numbering_at", "_numbering_part"


def numbered(rows: DataFrame, order: list[Column], name: str, within: str | None = None) -> DataFrame:
    """``rows`` with column ``name``: 0, 1, 2... in the order of ``order``, anew for each value of ``within``.

    Rows are dealt into ranges of the order and sorted there; a range's first number is the sum of
    the counts before it. What is broadcast has a row per range and one more per group at most, as
    each range holds a run of groups. Rows that ``order`` doesn't tell apart are numbered in any
    order, so ``order`` should end in something unique where other columns differ: a group of
    equal keys then spreads over ranges, too. Reads ``rows`` twice: give it a written table.
    """
    keys = ([F.col(within)] if within else []) + order
    group = [within] if within else []
    placed = table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn(_PART, F.shiftright(_AT, 33))
    counts = placed.groupBy(*group, _PART).agg(F.count("*").alias("n"), F.min(_AT).alias("first"))
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(g).alias("_numbering_group") for g in group], F.col(_PART).alias("_numbering_of"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_numbering_shift"))
    same = F.col(_PART) == F.col("_numbering_of")
    if within:
        same &= F.col(within).eqNullSafe(F.col("_numbering_group"))
    return placed.join(F.broadcast(shift), same).select(*rows.columns, (F.col(_AT) + F.col("_numbering_shift")).alias(name))

"""Joins on a key that a large share of the rows may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SHARE = 2_000  # a key is hot with one row in so many; so there are never more hot keys than this
LEAST = 256  # and with so many rows


def hot_keys(counts: DataFrame, on: list[str]) -> tuple[list[Row], int]:
    """The hot keys of ``counts`` (the columns ``on``, and n: rows with that key) with the number of
    salts each gets, and the rows that one salt holds. At most ``SHARE`` keys reach the driver."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    step = max(LEAST, -(-total // SHARE))
    return counts.where(F.col("n") >= step).select(*on, F.ceil(F.col("n") / step).cast("int").alias("salts")).collect(), step


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, hot: list[Row]) -> DataFrame:
    """``left`` joined with ``right`` (one row per key); rows of a hot key are dealt by column ``by``.

    Each row of a hot key in ``left`` gets one of its salts, and the row in ``right`` stands once
    for each, so no task gets all rows of a key.
    """
    if not hot:
        return left.join(right, on)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    salts = F.broadcast(left.sparkSession.createDataFrame(hot, ", ".join(f"{k} {kinds[k]}" for k in on) + ", salts int"))
    dealt = left.join(salts, on, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), "salts").cast("int"), F.lit(0))).drop("salts")
    copied = right.join(salts, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    return dealt.join(copied, [*on, "salt"]).drop("salt")

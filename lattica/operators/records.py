"""Append-only and versioned records: latest rows, upserts by view, overlays, carried rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import table


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; a total order makes it unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_with_ties(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """All rows that come first in their key: ties survive."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.rank().over(w)).where("_n = 1").drop("_n")


def override(branches: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key; a later branch overrides an earlier one."""
    out = None
    for k, b in enumerate(branches):
        b = b.withColumn("_priority", F.lit(k))
        out = b if out is None else out.unionByName(b)
    return latest(out, keys, F.col("_priority").desc()).drop("_priority")


def first_write_wins(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What is stored, and new rows of keys that aren't."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and stored rows of keys without a new one."""
    return new.unionByName(stored.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def overlay(own: DataFrame, shipped: DataFrame, keys: list[str]) -> DataFrame:
    """Own rows, and shipped ones of keys that own lacks."""
    return first_write_wins(own, shipped, keys)


def conflicts(stored: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose new value differs from the stored one (an insert of these is an error)."""
    s = stored.select(*keys, F.col(value).alias("stored_value"))
    return new.join(s, keys).where(~F.col(value).eqNullSafe(F.col("stored_value"))).select(*keys, "stored_value", F.col(value).alias("new_value"))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def fill_once(rows: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sets ``column`` where it is null and a value is known."""
    v = values.select(*keys, F.col(column).alias("_v"))
    return rows.join(v, keys, "left").withColumn(column, F.coalesce(column, "_v")).drop("_v")


def carry_forward(previous: DataFrame, judged: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """Earlier rows that are still judged and weren't retrieved anew."""
    return previous.join(judged.select(key), key, "left_semi").join(retrieved.select(key), key, "left_anti")


def with_counts(rows: DataFrame, key: str, counts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A listing with a count per related table, each counted before it is joined; 0 where none."""
    for name, (table, column) in counts.items():
        n = table.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name))
        rows = rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def running_total(rows: DataFrame, value: str, age: str, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each in the order of ``age``, then ``order``.

    Rows are cut at quantiles of ``age``; sums of the parts (a few rows) are added up first, so
    each part is summed alone and no task sees all rows. ``age`` is numeric.
    """
    cuts = sorted(set(rows.approxQuantile(age, [k / parts for k in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c <= F.col(age).cast("double")))
    rows = rows.withColumn("_part", part)
    before = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = before.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_part").orderBy(age, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(before), "_part")  # parts rows at most
    return out.withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_base")


def eviction(files: DataFrame, size: str, age: str, reserve: int, cap: int, keep: Column) -> DataFrame:
    """Files to delete, oldest first, until what is left and ``reserve`` fit in ``cap``.

    Kept files are skipped and still take room.
    """
    total = files.agg(F.sum(size)).first()[0] or 0
    out = running_total(files.where(~keep), size, age, [c for c in files.columns if c != age], "_before")
    return out.where(F.lit(total) - F.col("_before") + reserve > cap).drop("_before")


def daily_admission(events: DataFrame, at: str, user: str, order: list[str], user_limit: int, global_limit: int) -> DataFrame:
    """Events with whether they are admitted: below both caps of their UTC day, counted on admission.

    Per user and day at most ``user_limit`` can count, and of those the day's first ``global_limit``
    do. Both are limits of a rank, so tasks pass on no more rows of a day than the limit; the others
    are told by their absence.
    """
    rows = table(events.select("*", F.to_date(at).alias("day"), F.monotonically_increasing_id().alias("_row")), "events")
    key = rows.select("_row", "day", user, at, *order)
    own = key.withColumn("_n", F.row_number().over(Window.partitionBy("day", user).orderBy(at, *order, "_row"))).where(F.col("_n") <= user_limit)
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("day").orderBy(at, *order, "_row"))).where(F.col("_n") <= global_limit)
    found = first.select("_row", F.lit(True).alias("admitted"))
    return rows.join(found, "_row", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False))).drop("_row")

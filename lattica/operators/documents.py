"""JSON documents beside columns: canonical text, fields set in both, tallies of lists inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "map<string,variant>"


def canonical(document: Column) -> Column:
    """The document as compact JSON with keys in order at every depth; null stays null."""
    return F.to_json(F.parse_json(document))


def with_field(document: Column, name: str, value: Column) -> Column:
    """The document, canonical, with a top field set to a text; what is no object stays as it is."""
    fields = F.from_json(document, FIELDS)
    rest = F.map_filter(fields, lambda k, _: k != F.lit(name))
    new = F.map_concat(rest, F.create_map(F.lit(name), value.cast("variant")))
    return F.when(fields.isNull(), canonical(document)).otherwise(canonical(F.to_json(new)))


def fill_once(rows: DataFrame, values: DataFrame, keys: list[str], column: str, document: str) -> DataFrame:
    """Sets ``column`` and the field of that name in ``document`` where the column is null and a value is known; both or neither."""
    v = values.select(*keys, F.col(column).alias("_v"))
    fills = F.col(column).isNull() & F.col("_v").isNotNull()
    out = rows.join(v, keys, "left").withColumn(document, F.when(fills, with_field(F.col(document), column, F.col("_v"))).otherwise(F.col(document)))
    return out.withColumn(column, F.coalesce(column, "_v")).drop("_v")


def length_at(document: Column, path: str) -> Column:
    """How many entries the list at a path has; 0 where there is none."""
    return F.coalesce(F.json_array_length(F.get_json_object(document, path)), F.lit(0))


def tallies(reviews: DataFrame, document: str, verdicts: tuple[str, ...] = ("material", "held", "cleared")) -> DataFrame:
    """``reviews`` with the number of answers, findings, questions, of findings of each verdict, and of moves of each kind, from lists in a JSON column."""
    d = F.col(document)
    listed = F.coalesce(F.from_json(F.get_json_object(d, "$.findings"), "array<struct<verdict:string>>"), F.array().cast("array<struct<verdict:string>>"))
    out = {"answers": length_at(d, "$.case.answers"), "findings": length_at(d, "$.findings"), "questions": length_at(d, "$.questions")}
    is_ = lambda verdict: lambda f: f["verdict"] == verdict
    out |= {v: F.size(F.filter(listed, is_(v))) for v in verdicts}
    out |= {k: length_at(d, f"$.delta.{k}") for k in ("unchanged", "changed", "new", "addressed")}
    return reviews.withColumns({k: c.cast("int") for k, c in out.items()})

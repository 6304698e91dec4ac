"""Column expressions for ids, fingerprints, words and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"
#: words that ranking leaves out (fixed values)
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the their them there they this to was were what when where which who will with".split()


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix, underscore, and 24 hex digits of the parts' SHA-256; null parts count as empty."""
    joined = F.concat_ws(NUL, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 24))


def ordered_fingerprint(value: Column, *order: Column) -> Column:
    """Aggregate: SHA-256 over the values in the order of ``order``, joined by NUL."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], value.alias("v"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["v"]), NUL), 256)


def terms(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lowered text, stopwords left out; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(STOPWORDS))


def name_tokens(name: Column) -> Column:
    """Parts of an identifier: cut at camel humps, borders of letters and digits, other signs; lowered."""
    cut = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(cut)), " +"), lambda t: t != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def under(path: Column, prefix: Column) -> Column:
    """Whether a path lies in a folder, by path parts: src/apps isn't in src/app."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def unit_vector(v: Column) -> Column:
    """A vector over its length, in double; null where it has none."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a))
    return F.when(norm > 0, F.transform(v, lambda a: a / norm))


def dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity of two vectors, in double; null where one has no length."""
    return F.aggregate(F.zip_with(unit_vector(x), unit_vector(y), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def merged_maps(old: Column, new: Column) -> Column:
    """The entries of both maps, those of ``new`` where both have a key; null maps count as empty."""
    o, n = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (old, new))
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)

"""Pairs of sets that share much of the smaller one: prefix and length filters, then verification.

``overlap_pairs`` gives every pair, which grows with the square of equal sets; ``overlap_groups`` has one
set stand for those that are equal, and pairs of these only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import table


FEW = 20_000  # features of which a table is broadcast, at most
WORDS, BITS = 4, 62  # sets over at most WORDS * BITS features are held as words of so many bits


def _numbered(rows: DataFrame) -> DataFrame:
    """(feature, code): codes rise with the number of rows that hold a feature, so a set's codes in order are its features, the rarest first."""
    held = rows.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.count("*").alias("held"))
    sorted_ = held.repartitionByRange("held", "feature").sortWithinPartitions("held", "feature")
    return table(sorted_.select("feature", F.monotonically_increasing_id().alias("code")), "numbered")


def _sets(rows: DataFrame, group: list[str], features: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """(group..., item, members): each set's features as codes, the rarest first.

    Lines are shuffled once, as items and codes. With ``owners`` (group..., item) rows have no group
    columns, and a set belongs to each group of its item. No join of these is broadcast but that of few features.
    """
    features = _numbered(rows) if features is None else features
    n, top = features.agg(F.count("*"), F.max("code")).first()
    named = F.broadcast(features) if n <= FEW else features.hint("merge")
    code = F.col("code").cast("smallint" if (top or 0) < 1 << 15 else "long").alias("code")
    own = [] if owners is not None else group
    coded = rows.join(named, "feature").select(*own, "item", code).repartition(*own, "item")
    sets = coded.groupBy(*own, "item").agg(F.array_sort(F.collect_set("code")).alias("members"))
    if owners is not None:
        sets = sets.join(owners.select(*group, "item").distinct().hint("merge"), "item")
    return sets.select(*group, "item", "members")


MOST_TOGETHER = 4  # members of a key
KEYS = 8  # a key of more members is taken while keys are no more than so many a member


def _keyed(sets: DataFrame, group: list[str], upto: Column, together: int, base: int | None, carried: list[str]) -> DataFrame:
    """(group..., key, item, carried...): a key of every ``together`` of a set's first ``upto`` members, in order: their number to ``base``, or a hash."""
    kept = [*group, "item", *carried]
    rows, codes = sets.select(*kept, F.slice("members", 1, F.greatest(upto, F.lit(0))).alias("rest")), []
    for k in range(together):
        upto = F.greatest(F.size("rest") - (together - 1 - k), F.lit(0))
        rows = rows.select(*kept, *codes, "rest", F.posexplode(F.slice("rest", F.lit(1), upto)).alias("at", "code"))
        rows = rows.select(*kept, *codes, F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), F.col("code").cast("long").alias(f"c{k}"))
        codes.append(f"c{k}")
    key = reduce(lambda key, c: key * base + F.col(c), codes[1:], F.col("c0")) if base else F.xxhash64(*codes)
    return rows.select(*kept, key.alias("key"))


def _together(sets: DataFrame, least: int) -> int:
    """How many members meet at once: as many as ``least``, while the keys of all sets stay few."""
    n = F.size("members").cast("double")
    ways, keys = F.lit(1.0), []
    for t in range(1, min(MOST_TOGETHER, least) + 1):
        ways = F.lit(1.0)
        for k in range(t):
            ways = ways * (n - least + t - k) / (k + 1)
        keys.append(F.sum(ways).alias(f"k{t}"))
    members, *many = sets.where(F.size("members") >= least).agg(F.sum(n), *keys).first()
    return max([t for t, keys in enumerate(many, 1) if keys is not None and keys <= KEYS * members], default=1)


def candidates(sets: DataFrame, group: list[str], need: Column, least: int, together: int | None = None, words: int = 0) -> DataFrame:
    """(group..., x, y, nx, ny, n_shared and what is shared): pairs of sets (x the smaller, of equal ones the lesser) that share ``need`` members of x.

    ``need`` is ``least`` at least. Of what two sets share, the first t (``together``; 2) in the order of
    members have need - t more behind them in both, so they lie in x's first size - need + t and in y's
    first size - least + t, the rarest of each: sets meet on t of these at once. A feature that many
    sets hold is among them only of sets that hold little else, and t such features at once are rarer
    than each. Rows that meet carry their sets, and a pair is put out where the key is the first t that it
    shares: once, and without a shuffle or a table of pairs. Where codes are few, sets are ``words`` of bits
    (columns w0...; shared s0...), else arrays (shared).
    """
    together = together or min(2, least)
    base = words * BITS or None
    carried = [f"w{k}" for k in range(words)] or ["members"]
    sized = sets.withColumn("size", F.size("members")).withColumn("need", need).where(F.col("size") >= F.col("need"))
    x = _keyed(sized, group, F.col("size") - F.col("need") + together, together, base, carried)
    x = x.select(*group, "key", F.col("item").alias("x"), *[F.col(c).alias(f"x_{c}") for c in carried])
    y = _keyed(sized, group, F.col("size") - least + together, together, base, carried)
    y = y.select(*group, "key", F.col("item").alias("y"), *[F.col(c).alias(f"y_{c}") for c in carried])
    met = x.join(y.hint("merge"), [*group, "key"])
    if words:
        nx, ny = (sum((F.bit_count(f"{side}_w{k}") for k in range(1, words)), F.bit_count(f"{side}_w0")) for side in "xy")
        both = [F.col(f"x_w{k}").bitwiseAND(F.col(f"y_w{k}")) for k in range(words)]
        n = sum((F.bit_count(w) for w in both[1:]), F.bit_count(both[0]))
        last = F.pmod(F.col("key"), F.lit(base))
        sooner = [F.bit_count(w.bitwiseAND(_first_bits(last + 1 - k * BITS))) for k, w in enumerate(both)]
        is_first = sum(sooner[1:], sooner[0]) == together
        shared = [w.alias(f"s{k}") for k, w in enumerate(both)]
    else:
        nx, ny = F.size("x_members"), F.size("y_members")
        both_ = F.array_intersect("x_members", "y_members")
        n, shared = F.size(both_), [both_.alias("shared")]
        is_first = F.xxhash64(*[F.get(both_, F.lit(k)).cast("long") for k in range(together)]) == F.col("key")
    met = met.where((ny > nx) | (ny == nx) & (F.col("y") > F.col("x"))).where(is_first)
    out = met.select(*group, "x", "y", nx.alias("nx"), ny.alias("ny"), n.alias("n_shared"), *shared).withColumn("size", F.col("nx"))
    return out.where(F.col("n_shared") >= need).drop("size")


def _first_bits(n: Column) -> Column:
    """A word with its first ``n`` bits set: none from 0 down, all from ``BITS`` up."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.least(n, F.lit(BITS)), F.lit(0)).cast("int")) - 1


def _in_words(sets: DataFrame, words: int) -> DataFrame:
    """``sets`` with their members as bits of the columns w0...; bit c % BITS of word c div BITS is code c."""

    def word(k: int) -> Column:
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c.cast("int") - k * BITS))
        return F.aggregate(F.filter("members", lambda c: (c >= k * BITS) & (c < (k + 1) * BITS)), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(bit(c)))

    return sets.select("*", *[word(k).alias(f"w{k}") for k in range(words)])


def _words(features: DataFrame) -> int:
    """How many words hold a set, 0 where that is more than ``WORDS``."""
    top = features.agg(F.max("code")).first()[0] or 0
    return top // BITS + 1 if top < WORDS * BITS else 0


def _named(pairs: DataFrame, features: DataFrame, words: int) -> DataFrame:
    """``pairs`` with the array of shared features in place of their codes."""
    if words:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("code", F.lit(BITS)).cast("int"))
        bits = [F.when(F.floor(F.col("code") / BITS) == k, bit).otherwise(F.lit(0).cast("long")).alias(f"b{k}") for k in range(words)]
        names = features.agg(F.array_sort(F.collect_list(F.struct("code", *bits, "feature"))).alias("names"))
        held = lambda f: reduce(Column.bitwiseOR, [F.col(f"s{k}").bitwiseAND(f[f"b{k}"]) for k in range(words)]) != 0
        shared = F.transform(F.filter("names", held), lambda f: f["feature"])
        return pairs.crossJoin(F.broadcast(names)).withColumn("shared", shared).drop("names", *[f"s{k}" for k in range(words)])
    rest = [c for c in pairs.columns if c != "shared"]
    few = F.broadcast(features) if features.count() <= FEW else features.hint("merge")
    each = pairs.select(*rest, F.explode("shared").alias("code")).join(few, "code")
    return each.groupBy(*rest).agg(F.collect_list("feature").alias("shared"))


def _counted(pairs: DataFrame, features: DataFrame, words: int, counts: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``pairs`` with the numbers of shared features that a condition holds for, in place of their codes."""
    if not counts:
        return pairs.drop("shared", *[f"s{k}" for k in range(words)])
    if not words:
        named = _named(pairs, features, words)
        return named.select("*", *[F.size(F.filter("shared", of)).cast("long").alias(name) for name, of in counts.items()]).drop("shared")
    rows = features.select("code", *[of(F.col("feature")).alias(name) for name, of in counts.items()]).collect()  # at most WORDS * BITS
    masks = {name: [sum(1 << r["code"] % BITS for r in rows if r[name] and r["code"] // BITS == k) for k in range(words)] for name in counts}
    bits = {name: [F.bit_count(F.col(f"s{k}").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(mask)] for name, mask in masks.items()}
    return pairs.select("*", *[reduce(Column.__add__, n).cast("long").alias(name) for name, n in bits.items()]).drop(*[f"s{k}" for k in range(words)])


def _pairs(sets: DataFrame, words: int, least: int, share: float, group: list[str]) -> DataFrame:
    """(group..., a, b, na, nb, n_shared and what is shared) of a table of sets, in codes."""
    need = F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("size") - F.lit(1e-9)).cast("int"))
    met = candidates(sets, group, need, least, _together(sets, least), words)
    met = met.where(F.col("n_shared") >= F.lit(share) * F.least("nx", "ny"))
    first = F.col("x") < F.col("y")
    na, nb = F.when(first, F.col("nx")).otherwise(F.col("ny")), F.when(first, F.col("ny")).otherwise(F.col("nx"))
    shared = [f"s{k}" for k in range(words)] or ["shared"]
    return met.select(*group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), na.alias("na"), nb.alias("nb"), "n_shared", *shared)


def overlap_pairs(rows: DataFrame, least: int, share: float, group: list[str] | None = None) -> DataFrame:
    """(group..., a, b, na, nb, n_shared, shared): pairs a < b of which the smaller set has ``least`` features, as many are shared, and that share of its own.

    rows: group columns, item, feature (a set is a row once its features are counted). Only
    sets of one group meet. ``shared`` is the array of shared features.
    """
    group = group or []
    features = _numbered(rows)
    words = _words(features)
    sets = table(_in_words(_sets(rows, group, features).where(F.size("members") >= least), words), "sets")
    return _named(_pairs(sets, words, least, share, group), features, words)


def overlap_groups(rows: DataFrame, least: int, share: float, group: list[str] | None = None, owners: DataFrame | None = None, counts: dict[str, Callable[[Column], Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (group..., a, b, n_shared, and the ``counts`` of shared features by name and condition) of sets that stand for equal ones, and members (group..., item, of, size) of all sets of ``least`` features.

    Of equal sets of a group the least item stands for all (``of``). A pair a < b says that each member
    of a's class and each of b's are a pair of ``overlap_pairs``, sharing the same; a pair a = b
    says so of two members of that class, and is there if it has two. So no pair is lost and none
    is written per copy. Groups are columns of ``rows`` or of ``owners`` (see ``_sets``).
    """
    group = group or []
    features = _numbered(rows)
    words = _words(features)
    looks = table(_sets(rows, group, features, owners).where(F.size("members") >= least), "looks")
    classes = looks.groupBy(*group, "members").agg(F.min("item").alias("item"), F.count("*").alias("copies"))
    classes = table(_in_words(classes, words), "classes")
    members = looks.join(classes.select(*group, "members", F.col("item").alias("of")).hint("merge"), [*group, "members"])
    members = members.select(*group, "item", "of", F.size("members").cast("long").alias("size"))
    one = _pairs(classes, words, least, share, group).drop("na", "nb")
    shared = [F.col(f"w{k}").alias(f"s{k}") for k in range(words)] or [F.col("members").alias("shared")]
    own = classes.where("copies > 1").select(*group, F.col("item").alias("a"), F.col("item").alias("b"), F.size("members").alias("n_shared"), *shared)
    return _counted(one.unionByName(own), features, words, counts or {}), members

"""Policy documents, labels, namespaces, citations, and the gate over retrieval examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (8, 12, 16, 20)


def parse_policies(files: DataFrame, required: list[str]) -> DataFrame:
    """(path, id, title, scope, strength, applies_to, tags, body, sections, content_hash, error) of Markdown texts (path, text).

    A text begins with a line ---, lines ``key: value`` and a line ---; sections of the body start at
    lines ``## heading``, and the map's keys are lowered headings. ``error`` names the first fault:
    no front matter, a missing field, a heading twice, a required section missing or empty.
    Identities that two texts state are an error of both. One pass, then a count per id.
    """
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    line = lambda k: F.regexp_replace(F.regexp_extract("front", rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1), r"^[\"']|[\"']$", "")
    p = files.withColumn("front", front).withColumn("body", F.trim(F.regexp_replace(F.regexp_replace("text", r"(?s)\A---\n.*?\n---", ""), r"\A\s+|\s+\z", "")))
    names = ("id", "title", "scope", "strength", "applies_to")
    p = p.select("path", "front", "body", *[F.nullif(line(k), F.lit("")).alias(k) for k in names], F.regexp_replace(line("tags"), r"^\[|\]$", "").alias("tags"), F.sha2("text", 256).alias("content_hash"))
    cut = F.slice(F.split("body", r"(?m)^##[ \t]+"), 2, 10_000_000)
    heading = lambda x: F.lower(F.trim(F.regexp_extract(x, r"\A([^\n]*)", 1)))
    text = lambda x: F.regexp_replace(F.regexp_replace(x, r"\A[^\n]*\n?", ""), r"\A\s+|\s+\z", "")
    p = p.withColumn("heads", F.transform(cut, heading)).withColumn("texts", F.transform(cut, text))
    p = p.withColumn("twice", F.size("heads") != F.size(F.array_distinct("heads")))
    p = p.withColumn("sections", F.when(~F.col("twice"), F.map_from_arrays("heads", "texts")))
    wanted = F.array(*[F.lit(r.lower()) for r in required])
    absent = F.array_join(F.array_sort(F.array_except(wanted, F.col("heads"))), ", ")
    empty = F.array_join(F.array_sort(F.filter(wanted, lambda r: F.element_at("sections", r) == "")), ", ")
    same = F.count("*").over(Window.partitionBy("id"))
    error = F.when(F.col("front") == "", "no front matter")
    for k in ("id", "title", "scope", "strength"):
        error = error.when(F.col(k).isNull(), f"no {k}")
    error = error.when(F.col("twice"), "a section twice").when(absent != "", F.concat(F.lit("missing: "), absent)).when(empty != "", F.concat(F.lit("empty: "), empty)).when(same > 1, "an id twice")
    tags = F.when(F.col("tags") != "", F.transform(F.split("tags", ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    return p.select("path", *names, tags.alias("tags"), "body", "sections", "content_hash", error.alias("error"))


def label_rows(labels: DataFrame, found: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grades (case, document, grade) of labelled cases, and misses (case, problem).

    labels: case, bearing, supporting, adjacent (arrays of documents, 3 to 1). found: cases that
    the detectors gave. A label without a case, a case without a label and a document that is no
    policy are misses; of a document in two lists the highest grade counts.
    """
    parts = [labels.select("case", F.explode(c).alias("document"), F.lit(g).alias("grade")) for c, g in (("bearing", 3), ("supporting", 2), ("adjacent", 1))]
    grades = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("case", "document").agg(F.max("grade").alias("grade"))
    miss = labels.select("case").join(found.select("case"), "case", "left_anti").withColumn("problem", F.lit("label without case"))
    miss = miss.unionByName(found.select("case").join(labels.select("case"), "case", "left_anti").withColumn("problem", F.lit("case without label")))
    unknown = grades.join(policies.select("document"), "document", "left_anti").select("case", F.lit("unknown document").alias("problem")).distinct()
    return grades, miss.unionByName(unknown)


def whole_chunks(docs: DataFrame, key: str, title: Column, body: Column) -> DataFrame:
    """(key, position, text): each document as one chunk, the title in front."""
    return docs.select(key, F.lit(1).alias("position"), F.concat(title, F.lit("\n\n"), F.regexp_replace(body, r"\A\s+|\s+\z", "")).alias("text"))


def namespace(identity: Column) -> Column:
    """Partition of the vectors of one model: 24 hex digits of its identity's SHA-256."""
    return F.substring(F.sha2(identity.cast("string"), 256), 1, 24)


def in_namespace(chunks: DataFrame, identity: str) -> DataFrame:
    """The chunks of one model; others are never compared with them."""
    return chunks.where(F.col("namespace") == namespace(F.lit(identity)))


def cited(citations: DataFrame, presented: DataFrame) -> DataFrame:
    """(finding, document, note): citations of presented documents only, the first of each."""
    w = Window.partitionBy("finding", "document").orderBy("position")
    rows = citations.join(presented.select("finding", "document").distinct(), ["finding", "document"], "left_semi").withColumn("_n", F.row_number().over(w))
    return rows.where("_n = 1").select("finding", "document", "note", "position")


def gate(examples: DataFrame) -> DataFrame:
    """Per k: the five figures of retrieval and whether all reach their floors; ``smallest`` marks the least k that passes.

    examples: k, pattern, expected, expected_found, mandatory, mandatory_found (counts),
    reference, retrieved (nullable booleans: the verdict by hand and with what was retrieved).
    """
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("expected_found") / F.col("expected"))
    rows = examples.withColumn("recall", recall)
    per = rows.groupBy("k", "pattern").agg(F.avg("recall").alias("r")).groupBy("k").agg(F.min("r").alias("pattern_recall"))
    moved = F.col("reference") != F.col("retrieved")
    out = rows.groupBy("k").agg(
        F.avg("recall").alias("recall"),
        F.avg((F.col("expected_found") == F.col("expected")).cast("double")).alias("complete"),
        F.coalesce(F.try_divide(F.sum("mandatory_found"), F.sum("mandatory")), F.lit(1.0)).alias("mandatory"),
        F.coalesce(F.try_divide(F.count_if(moved), F.count(moved)), F.lit(0.0)).alias("regression"),
    ).join(per, "k")
    passes = (F.col("recall") >= 0.95) & (F.col("pattern_recall") >= 0.90) & (F.col("complete") >= 0.75) & (F.col("mandatory") == 1.0) & (F.col("regression") <= 0.10)
    out = out.withColumn("passes", passes)
    least = out.where("passes").agg(F.min("k").alias("least"))
    out = out.crossJoin(F.broadcast(least)).withColumn("smallest", F.coalesce(F.col("passes") & (F.col("k") == F.col("least")), F.lit(False)))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("k", r("recall"), r("pattern_recall"), r("complete"), r("mandatory"), r("regression"), "passes", "smallest")


def smallest_passing(gated: DataFrame) -> int:
    """The least k that passes; an error where none does."""
    row = gated.where("smallest").first()
    if row is None:
        raise ValueError("no k passes the gate")
    return row["k"]


def signature(pattern: Column, roles: Column) -> Column:
    """What two candidates must share to be one's successor: the pattern, and the roles in order with repeats."""
    return F.struct(pattern.alias("pattern"), F.array_sort(roles).alias("roles"))


def corpus_moved(candidates: DataFrame, recorded: DataFrame, now: str) -> DataFrame:
    """(candidate, moved): a recorded fingerprint that isn't the present one; without a record nothing moved."""
    r = recorded.select("candidate", "fingerprint")
    return candidates.select("candidate").join(r, "candidate", "left").select("candidate", F.coalesce(F.col("fingerprint") != F.lit(now), F.lit(False)).alias("moved"))


def new_questions(asked: DataFrame, excluded: DataFrame, most: int = 8) -> DataFrame:
    """(round, key, text, options): one question per key, keys that were asked before left out, ``most`` a round.

    asked: round, position, facet, candidates (array), text, options (array). The key is of facet
    and distinct candidates in order; options are distinct whatever their case, in order.
    """
    key = F.sha2(F.concat_ws("\0", "facet", F.array_join(F.array_sort(F.array_distinct("candidates")), "\0")), 256)
    low = F.transform("options", F.lower)
    first = F.filter("options", lambda o, i: F.array_position(low, F.lower(o)) == i + 1)
    q = asked.withColumn("key", key).withColumn("options", first).join(excluded.select("key"), "key", "left_anti")
    q = q.withColumn("_n", F.row_number().over(Window.partitionBy("round", "key").orderBy("position"))).where("_n = 1")
    q = q.withColumn("_n", F.row_number().over(Window.partitionBy("round").orderBy("position", "key"))).where(F.col("_n") <= most)
    return q.select("round", "key", "text", "options")


def query_text(title: Column, claim: Column, pattern: Column, roles: Column, constraints: Column, answers: Column) -> Column:
    """Six lines that a candidate is searched with; "none" and "nothing yet" where a list is empty."""
    listed = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, "; ")).otherwise(F.lit(none))
    parts = [("Title: ", title), ("Claim: ", claim), ("Pattern: ", pattern), ("Roles: ", listed(roles, "none")), ("Constraints: ", listed(constraints, "none")), ("Answers: ", listed(answers, "nothing yet"))]
    return F.concat_ws("\n", *[F.concat(F.lit(name), F.coalesce(value, F.lit(""))) for name, value in parts])

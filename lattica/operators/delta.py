"""Differences between snapshots of candidates, with causes; what to judge; the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_delta(current: DataFrame, previous: DataFrame, older: DataFrame, causes: dict[str, bool], moved: DataFrame | None = None) -> DataFrame:
    """(candidate, state, causes, predecessor) of each candidate of either snapshot.

    Snapshots: candidate, signature, content, evidence. ``causes``: whole-run causes in their
    order (CASE, MODEL, PROMPT), true where that moved. ``moved``: candidates whose policies did.
    A candidate that was missing from the previous snapshot and is in an older one is resurfaced;
    one that alone bears the signature of a missing candidate alone succeeds it (several may).
    """
    cur = current.select("candidate", "signature", F.col("content").alias("content_now"), F.col("evidence").alias("evidence_now"))
    prev = previous.select("candidate", F.col("signature").alias("signature_was"), F.col("content").alias("content_was"), F.col("evidence").alias("evidence_was"))
    j = cur.join(prev, "candidate", "full_outer")
    gone = prev.join(cur.select("candidate"), "candidate", "left_anti")
    alone = gone.groupBy("signature_was").agg(F.count("*").alias("n"), F.min("candidate").alias("predecessor")).where("n = 1").select(F.col("signature_was").alias("signature"), "predecessor")
    j = j.join(alone, "signature", "left").join(older.select("candidate", F.lit(True).alias("was_older")).distinct(), "candidate", "left")
    if moved is not None:
        j = j.join(moved.select("candidate", F.lit(True).alias("policies_moved")).distinct(), "candidate", "left")
    else:
        j = j.withColumn("policies_moved", F.lit(None).cast("boolean"))
    fresh = F.col("content_was").isNull() & F.col("content_now").isNotNull()
    resurfaced = fresh & F.coalesce("was_older", F.lit(False))
    succeeds = fresh & ~resurfaced & F.col("predecessor").isNotNull()
    both = F.col("content_was").isNotNull() & F.col("content_now").isNotNull()
    shape = both & (F.col("content_was") != F.col("content_now"))
    content = both & ~shape & (F.col("evidence_was") != F.col("evidence_now"))
    said = [
        F.when(resurfaced, "RESURFACED"),
        F.when(succeeds | shape, "SHAPE"),
        F.when(content, "CONTENT"),
        F.when(both & F.coalesce("policies_moved", F.lit(False)), "POLICIES"),
        *[F.when(both & F.lit(on), name) for name, on in causes.items()],
    ]
    why = F.concat_ws(",", *said)
    j = j.withColumn("causes", why).withColumn("predecessor", F.when(succeeds, F.col("predecessor")))
    taken = j.where("predecessor is not null").select(F.col("predecessor").alias("candidate"), F.lit(True).alias("succeeded")).distinct()
    j = j.join(taken, "candidate", "left").where(~(F.col("content_now").isNull() & F.coalesce("succeeded", F.lit(False))))
    state = F.when(F.col("content_now").isNull(), "addressed").when(F.col("causes") != "", "changed").when(both, "unchanged").otherwise("new")
    return j.select("candidate", state.alias("state"), "causes", "predecessor")


def selected(delta: DataFrame) -> DataFrame:
    """Candidates to judge: changed and new ones."""
    return delta.where(F.col("state").isin("changed", "new")).select("candidate")


def gate(findings: DataFrame, decisions: DataFrame, delta: DataFrame) -> DataFrame:
    """Findings (candidate, verdict, held) judged this run, with whether they block.

    Material, not held, and decided neither under their own id nor their predecessor's.
    """
    d = decisions.select("candidate").distinct()
    f = findings.join(selected(delta), "candidate", "left_semi").join(delta.select("candidate", "predecessor"), "candidate", "left")
    f = f.join(d.withColumn("own", F.lit(True)), "candidate", "left")
    f = f.join(d.select(F.col("candidate").alias("predecessor"), F.lit(True).alias("inherited")), "predecessor", "left")
    blocks = (F.col("verdict") == "material") & ~F.col("held") & F.col("own").isNull() & F.col("inherited").isNull()
    return f.select("candidate", "verdict", blocks.alias("blocks"))


def question_key(facet: Column, candidates: Column) -> Column:
    return F.sha2(F.concat_ws("\0", facet, F.array_join(F.array_sort(F.array_distinct(candidates)), "\0")), 256)


def stale(verdict: Column, decided: Column) -> Column:
    """A decision on another verdict than the present one; none isn't stale."""
    return decided.isNotNull() & (decided != verdict)


def needs_attention(verdict: Column, decided: Column) -> Column:
    return stale(verdict, decided) | ((verdict != "cleared") & decided.isNull())


def completed_answers(questions: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """(key..., status, value, actor): every question with its answer, or SKIPPED by the user; an answer to no question is an error."""
    unknown = answers.join(questions.select(*key), key, "left_anti").select(*key).limit(5).collect()
    if unknown:
        raise ValueError(f"answers name unknown questions: {', '.join(sorted(str(tuple(r)) for r in unknown))}")
    a = answers.select(*key, "status", "value", "actor")
    return questions.select(*key).join(a, key, "left").select(*key, F.coalesce("status", F.lit("SKIPPED")).alias("status"), "value", F.coalesce("actor", F.lit("user")).alias("actor"))

"""Order, limits and text of reports; excerpts of sources; result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: order of verdicts in a report, and of signals by how much they weigh (fixed values)
VERDICTS = ("material", "held", "cleared")
SEVERITY = ("error", "warning", "notice")
MOST_ROWS, MOST_CHARS = 30, 2_500
COMMENT_LINES, EXCERPT_LINES = 12, 60


def place_in(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in a fixed order; others come last."""
    return F.coalesce(*[F.when(value == v, i) for i, v in enumerate(order)], F.lit(len(order)))


def report_order(findings: DataFrame) -> DataFrame:
    """findings (finding, verdict) with position: material, held, cleared, then by name whatever its case."""
    w = Window.partitionBy("repository").orderBy(place_in(F.col("verdict"), VERDICTS), F.lower("finding"), "finding")
    return findings.withColumn("position", F.row_number().over(w))


def docket(findings: DataFrame, limit: int) -> DataFrame:
    """The first rows of findings (finding, moved, verdict, summary) with a place: what moved, then by verdict, then summaries as people sort them, whatever their case and accents."""
    order = [F.col("moved").desc(), place_in(F.col("verdict"), VERDICTS), F.collate("summary", "UNICODE"), F.col("finding")]
    top = findings.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over limit rows


def limited_lines(rows: DataFrame, key: str, line: Column, *order: Column, most: int = MOST_ROWS) -> DataFrame:
    """(key, position, line): the first lines of each key, cut at ``MOST_CHARS``, and one that says how many more there are.

    Counts are grouped before any row is ranked, and only a key's own rows share a task.
    """
    r = rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("position"), line.alias("line")).where(F.col("position") <= most)
    shown = r.withColumn("line", F.when(F.length("line") > MOST_CHARS, F.concat(F.substring("line", 1, MOST_CHARS), F.lit("..."))).otherwise(F.col("line")))
    more = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return shown.unionByName(more.select(key, F.lit(most + 1).alias("position"), F.concat(F.lit("... and "), F.col("n") - most, F.lit(" more")).alias("line")))


def markdown_report(sections: DataFrame) -> DataFrame:
    """(repository, report): a repository's sections (ordinal, heading, position, line) as one Markdown text; empty ones say none."""
    part = sections.groupBy("repository", "ordinal", "heading").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("position", "line")))).alias("rows"))
    body = F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["line"])), "\n")).otherwise(F.lit("None."))
    part = part.select("repository", "ordinal", F.concat(F.lit("## "), "heading", F.lit("\n\n"), body).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return part.groupBy("repository").agg(F.concat(F.lit("# Report\n\n"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n"), F.lit("\n")).alias("report"))


def excerpts(spans: DataFrame, files: DataFrame) -> DataFrame:
    """(span, first, last, text, note) of spans (span, path, start, end) in files (path, source).

    Widened upwards over at most ``COMMENT_LINES`` lines right above that begin with #, bounded to
    ``EXCERPT_LINES``; the note says both. Paths that are absolute or climb, and files that are
    not there, give no row.
    """
    safe = spans.where(~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), ".."))
    r = safe.join(files.select("path", F.split("source", "\n").alias("lines")), "path")
    above = F.reverse(F.slice("lines", F.greatest(F.col("start") - COMMENT_LINES, F.lit(1)), F.least(F.col("start") - 1, F.lit(COMMENT_LINES))))
    plain = F.array_position(F.transform(above, lambda x: F.trim(x).startswith("#")), False)
    wide = F.when(plain == 0, F.size(above)).otherwise(plain - 1)
    r = r.withColumn("first", (F.col("start") - wide).cast("int")).withColumn("last", F.least("end", F.col("first") + EXCERPT_LINES - 1, F.size("lines")))
    text = F.array_join(F.slice("lines", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n")
    widened = F.when(F.col("first") < F.col("start"), F.concat(F.lit("widened by "), F.col("start") - F.col("first"), F.lit(" comment lines")))
    cut = F.when(F.col("last") < F.col("end"), F.concat(F.lit("cut at line "), F.col("last"), F.lit(" of "), F.col("end")))
    return r.select("span", "first", "last", text.alias("text"), F.concat_ws("; ", widened, cut).alias("note")).where("text <> ''")


def write_results(rows: DataFrame, path: str, kind: str) -> None:
    """Result rows as csv (with a header), json or yaml files; nested columns as JSON text in csv, an entry of a list a line in yaml."""
    if kind == "csv":
        rows = rows.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema])
        rows.write.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        rows.write.option("ignoreNullFields", False).json(path)
    elif kind == "yaml":  # flow style: JSON is YAML
        rows.select(F.concat(F.lit("- "), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})).alias("value")).write.text(path)
    else:
        raise ValueError(kind)


#: what each verdict of a report means
MEANING = {"material": "Evidence supports a concern worth acting on.", "held": "Waits on what the sources cannot tell.", "cleared": "Looked at and found to be no problem."}


def counted(n: Column, one: str) -> Column:
    """3 findings, but 1 finding."""
    return F.concat(n, F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


def review_sections(reviews: DataFrame, findings: DataFrame, moves: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(repository, ordinal, heading, position, line) of the nine sections of each review.

    reviews: repository, name, sequence, previous (null for the first), waiting, sources (array). findings:
    repository, finding, verdict, summary, limits (array). moves: repository, state (new, changed,
    addressed, unchanged), finding, causes. questions: repository, question, facet. answers: repository, question,
    value (null: skipped), actor. Sections of a verdict, and open questions, are there only where they
    have lines; limits are told once, with the verdicts they bear on. A section's lines are rows,
    in the order of their position.
    """

    def lines(rows: DataFrame, ordinal: int, heading: str | Column, position: Column, line: Column) -> DataFrame:
        head = F.lit(heading) if isinstance(heading, str) else heading
        return rows.select("repository", F.lit(ordinal).alias("ordinal"), head.alias("heading"), position.cast("string").alias("position"), line.alias("line"))

    known = reviews.select("repository", "name", "sequence", "previous", "waiting", "sources")
    n = findings.groupBy("repository").agg(F.count("*").alias("all"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    m = moves.groupBy("repository").agg(F.count_if(F.col("state").isin("new", "changed")).alias("moved"), F.count_if(F.col("state") == "addressed").alias("addressed"))
    head = known.join(n, "repository", "left").join(m, "repository", "left").fillna(0, ["all", *VERDICTS, "moved", "addressed"])
    judged = F.concat(counted(F.col("all"), "candidate"), F.lit(" judged: "), F.concat_ws(", ", *[F.concat(F.col(v), F.lit(f" {v}")) for v in VERDICTS]), F.lit("."))
    since = F.concat(F.lit(" "), F.col("moved"), F.lit(" moved since review "), F.col("previous"), F.lit(", "), F.col("addressed"), F.lit(" addressed."))
    none = F.lit("No candidates were found here; that says nothing about what was not looked for.")
    opening = F.array(
        F.concat("name", F.lit(", review "), "sequence"), F.when(F.col("waiting"), F.lit("Not final: it waits for answers.")), F.when(F.col("all") > 0, F.concat(judged, F.coalesce(since, F.lit("")))).otherwise(none)
    )
    parts = [lines(head.select("repository", F.posexplode(opening).alias("k", "text")).where("text is not null"), 1, "Review", F.col("k"), F.col("text"))]
    by_name = F.concat(F.lower("finding"), F.lit("\0"), "finding")
    for k, v in enumerate(VERDICTS):
        own = findings.where(F.col("verdict") == v).join(n.select("repository", F.col(v).alias("many")), "repository")
        title = F.concat(F.lit(f"{v.capitalize()} ("), "many", F.lit(")"))
        parts.append(lines(own, 2 + k, title, F.concat(F.lit("1"), by_name), F.concat("finding", F.lit(": "), "summary")))
        parts.append(lines(own.select("repository", "many").distinct(), 2 + k, title, F.lit("0"), F.lit(MEANING[v])))
    seen = findings.select("repository", "verdict", F.explode("limits").alias("limit")).groupBy("repository", "limit").agg(F.array_join(F.array_sort(F.collect_set("verdict")), ", ").alias("verdicts"))
    parts.append(lines(known, 5, "What could not be seen", F.lit(""), F.lit(None).cast("string")))
    parts.append(lines(seen, 5, "What could not be seen", F.concat("verdicts", F.lit("\0"), "limit"), F.concat("verdicts", F.lit(": "), "limit")))
    order = F.when(F.col("state") == "new", "0").when(F.col("state") == "changed", "1").otherwise("2")
    shown = moves.where("state <> 'unchanged'").join(known.select("repository", "previous"), "repository").where("previous is not null")
    moved = F.concat("state", F.lit(": "), "finding", F.coalesce(F.concat(F.lit(" ("), "causes", F.lit(")")), F.lit("")))
    parts.append(lines(shown, 6, "What moved", F.concat(order, by_name), moved))
    first = F.when(F.col("previous").isNull(), F.lit("The first review: all is new, and there is nothing to compare it with."))
    parts.append(lines(known, 6, "What moved", F.lit(""), first))
    asked = questions.join(known.select("repository", "waiting"), "repository")
    parts.append(lines(asked, 7, F.when(F.col("waiting"), "Open questions").otherwise("Left unanswered"), F.col("question"), F.concat("question", F.lit(" ("), "facet", F.lit(")"))))
    said = F.concat("question", F.lit(": "), F.coalesce("value", F.lit("skipped")), F.lit(" ("), "actor", F.lit(")"))
    parts.append(lines(known, 8, "Judged against", F.lit(""), F.lit(None).cast("string")))
    parts.append(lines(answers, 8, "Judged against", F.col("question"), said))
    parts.append(lines(known, 9, "Where this comes from", F.lit(""), F.lit(None).cast("string")))
    parts.append(lines(known.select("repository", F.explode(F.array_distinct("sources")).alias("source")), 9, "Where this comes from", F.col("source"), F.col("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Retrieval, ranking, measures and index queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import STOPWORDS, ordered_fingerprint, stable_id
from lattica.functions.storage import table
from lattica.operators import records, retrieval
from lattica.operators.quantiles import quantiles
from lattica.plans.fixtures import Tables, with_
from lattica.plans.registry import registry

QUERIES, ORACLES, query = registry()

EVERY = 20  # the queries of a search: ids that it divides
DENSE = """chunks as (select label as document, vec_id as chunk, cast(embedding as double[]) as v from embeddings),
 asked as (select vec_id as query, cast(embedding as double[]) as q from embeddings where vec_id % 20 = 0),
 best as (select query, document, max(round(list_cosine_similarity(v, q), 6)) as score from chunks cross join asked group by query, document),
 dense as (select query, document, score, row_number() over (partition by query order by score desc, document) as rank from best)"""


def _chunks(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("label").alias("document"), F.col("vec_id").alias("chunk"), "embedding")


def _asked(t: Tables) -> DataFrame:
    return t.embeddings.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query("dense_topk", with_(DENSE, body="select query, document, score, rank from dense where rank <= 5"))
def _(t: Tables) -> DataFrame:
    return retrieval.dense_search(_chunks(t), _asked(t), 5)


@query("dense_topk_overlay", with_(DENSE.replace("from embeddings)", "from embeddings where vec_id % 3 = 0 union all select label + 100, vec_id, cast(embedding as double[]) from embeddings where vec_id % 3 <> 0)", 1), body="select query, document, score, rank from dense where rank <= 8"))
def _(t: Tables) -> DataFrame:
    own = _chunks(t).where("chunk % 3 = 0")
    shipped = _chunks(t).withColumn("document", F.col("document") + 100)
    return retrieval.dense_search(records.overlay(own, shipped, ["chunk"]), _asked(t), 8)


RULE = "(scope = 'general' or (scope = 'user' and coalesce(applies_to = 'ada', false)) or (scope = 'organisation' and coalesce(applies_to = 'acme', false)) or (scope in ('repository', 'adr') and coalesce(applies_to = 'shop', false)))"


@query("scoped_filter", with_("policies", body=f"select document, {RULE} as applies, {RULE} and (scope <> 'general' or strength = 'required') as mandatory from policies"))
def _(t: Tables) -> DataFrame:
    rule = retrieval.applies("ada", "acme", "shop")
    return t.policies().select("document", rule.alias("applies"), (rule & F.expr("scope <> 'general' or strength = 'required'")).alias("mandatory"))


@query("mandatory_merge", with_("policies", DENSE, f"fit as (select * from policies where {RULE})", "must as (select document from fit where scope <> 'general' or strength = 'required')", body="""select query, document, score, reason, row_number() over (partition by query order by reason, score desc nulls last, document) as rank from (
 select query, document, cast(null as double) as score, 'mandatory' as reason from must cross join (select distinct query from dense) union all
 select query, document, score, 'retrieved' from dense where rank <= 5 and document in (select document from fit) and document not in (select document from must))"""))
def _(t: Tables) -> DataFrame:
    dense = retrieval.dense_search(_chunks(t), _asked(t), 5).select("query", "document", "score")
    return retrieval.scoped_merge(t.policies(), dense, retrieval.applies("ada", "acme", "shop"))


@query("oracle_retriever", with_("policies", body="select document, row_number() over (order by document) as rank from policies"))
def _(t: Tables) -> DataFrame:
    return retrieval.ranked(t.policies().select("document", F.lit(1).alias("q")), "q", None, F.col("document")).select("document", "rank")


TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: not list_contains([" + ", ".join(f"'{w}'" for w in STOPWORDS) + "], x))"
BM25 = f"""t as (select doc_id as document, {TOKENS} as terms from documents),
 stats as (select count(*) as n, avg(len(terms)) as avg_len from t),
 asked as (select query, term, count(*) as times from (select item_id as query, unnest({TOKENS}) as term from benchmark) group by query, term),
 tf as (select document, len, term, count(*) as tf from (select document, len(terms) as len, unnest(terms) as term from t) where term in (select term from asked) group by document, len, term),
 df as (select term, count(*) as df from tf group by term),
 bm as (select query, document, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) as score from tf join df using (term) join asked using (term) cross join stats group by query, document),
 ranking as (select query, document, score, row_number() over (partition by query order by score desc, document) as rank from bm where score > 0)"""


def _index(t: Tables) -> retrieval.Postings:
    docs = t.documents.select(F.col("doc_id").alias("chunk"), F.col("doc_id").alias("document"), "text")
    return retrieval.bm25_index(docs, t.benchmark.select(F.col("item_id").alias("query"), "text"))


def _judged(t: Tables, bearing: DataFrame | None = None) -> DataFrame:
    """(query, document, score, rank) of the bearing documents that are found."""
    return retrieval.bm25_ranks(_index(t), (t.bearing() if bearing is None else bearing).select("query", "document"))


@query("bm25_topk", with_(BM25, body="select query, document, round(score, 4) as score from ranking where rank <= 5"))
def _(t: Tables) -> DataFrame:
    return retrieval.bm25(_index(t), 5).select("query", "document", F.round("score", 4).alias("score"))


@query("bm25_ranks", with_("bearing", BM25, body="select query, document, round(score, 4) as score, rank from ranking join (select distinct query, document from bearing) using (query, document)"))
def _(t: Tables) -> DataFrame:
    return _judged(t).select("query", "document", F.round("score", 4).alias("score"), "rank")


MEASURES = """rel as (select query, count(*) as relevant from bearing where grade = 3 group by query),
 ideal as (select query, sum((pow(2, grade) - 1) / log2(place + 1)) as ideal from (select query, grade, row_number() over (partition by query order by grade desc, document) as place from bearing) where place <= 10 group by query),
 hits as (select query, rank, grade, cast(grade = 3 as int) as hit, sum(cast(grade = 3 as int)) over (partition by query order by rank) as so_far from ranking join bearing using (query, document)),
 agg as (select query, sum(case when rank <= 10 then hit else 0 end) as found, min(case when hit = 1 then rank end) as first_, sum(case when hit = 1 then so_far / rank else 0 end) as ap, sum(case when rank <= 10 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as gain from hits group by query),
 measures as (select query, round(case when coalesce(relevant, 0) = 0 then 1.0 else coalesce(found, 0) / relevant end, 6) as recall, round(coalesce(found, 0) / 10, 6) as precision, coalesce(found, 0) = coalesce(relevant, 0) as complete,
  round(coalesce(1 / first_, 0.0), 6) as reciprocal_rank, round(case when coalesce(relevant, 0) = 0 then 1.0 else coalesce(ap / relevant, 0.0) end, 6) as average_precision, round(coalesce(gain / nullif(ideal, 0), 0.0), 6) as ndcg
  from (select query from ranking union select query from bearing) left join rel using (query) left join ideal using (query) left join agg using (query))"""


def _measures(t: Tables) -> DataFrame:
    index, bearing = _index(t), table(t.bearing(), "bearing")
    return retrieval.measures(retrieval.bm25_ranks(index, bearing), bearing, 10, index.asked.select("query").distinct())


@query("ir_metrics", with_("bearing", BM25, MEASURES, body="select query, cast(recall as double) as recall, cast(precision as double) as precision, complete, cast(reciprocal_rank as double) as reciprocal_rank, cast(average_precision as double) as average_precision, cast(ndcg as double) as ndcg from measures"))
def _(t: Tables) -> DataFrame:
    return _measures(t)


@query("ir_summary", with_("bearing", BM25, MEASURES, "labels as (select item_id as query, case when length(text) > 200 then 'long' else 'short' end as pattern, case when item_id % 2 = 0 then 'even' else 'odd' end as kind from benchmark)", body="""select case grouping(pattern, kind) when 3 then 'overall' when 1 then 'pattern' else 'kind' end as level, pattern, kind, count(*) as queries, round(avg(recall), 4) as recall, round(avg(reciprocal_rank), 4) as reciprocal_rank, round(avg(average_precision), 4) as average_precision, round(avg(ndcg), 4) as ndcg
 from measures left join labels using (query) group by grouping sets ((), (pattern), (kind))"""))
def _(t: Tables) -> DataFrame:
    labels = t.benchmark.select(F.col("item_id").alias("query"), F.when(F.length("text") > 200, "long").otherwise("short").alias("pattern"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    return retrieval.summary(_measures(t), labels)


@query("release_gate", with_("bearing", BM25, "ks as (select unnest([8, 12, 16, 20]) as k)", """per as (select k, b.query, count(*) as relevant, count(r.rank) as found from ks cross join (select * from bearing where grade = 3) b left join ranking r on r.query = b.query and r.document = b.document and r.rank <= k group by k, b.query)""", body="select k, round(avg(found / relevant), 6) as recall, round(avg(case when found = relevant then 1.0 else 0.0 end), 6) as complete, avg(found / relevant) >= 0.95 and avg(case when found = relevant then 1.0 else 0.0 end) >= 0.75 as passes from per group by k"))
def _(t: Tables) -> DataFrame:
    spark = t.spark
    ks = spark.createDataFrame([(8,), (12,), (16,), (20,)], "k int")
    bearing = table(t.bearing().where("grade = 3"), "bearing")
    b = bearing.join(_judged(t, bearing).select("query", "document", "rank"), ["query", "document"], "left")
    per = b.crossJoin(F.broadcast(ks)).groupBy("k", "query").agg(F.count("*").alias("relevant"), F.count(F.when(F.col("rank") <= F.col("k"), 1)).alias("found"))
    recall, complete = F.avg(F.col("found") / F.col("relevant")), F.avg((F.col("found") == F.col("relevant")).cast("double"))
    return per.groupBy("k").agg(F.round(recall, 6).alias("recall"), F.round(complete, 6).alias("complete"), ((recall >= 0.95) & (complete >= 0.75)).alias("passes"))


@query("miss_table", with_("bearing", BM25, body="select b.document, count(*) as misses, median(r.rank) as median_rank from bearing b left join ranking r using (query, document) where coalesce(r.rank, 1000000) > 1 group by b.document"))
def _(t: Tables) -> DataFrame:
    bearing = table(t.bearing(), "bearing")
    b = table(bearing.join(_judged(t, bearing).select("query", "document", "rank"), ["query", "document"], "left").where("coalesce(rank, 1000000) > 1"), "misses")
    misses = b.groupBy("document").agg(F.count("*").alias("misses"))
    return misses.join(quantiles(b, ["document"], "rank", {"median_rank": 0.5}).drop("n"), "document", "left")


@query("cumulative_share", with_("bearing", BM25, "hits as (select rank, count(*) as n from bearing join ranking using (query, document) group by rank)", body="select rank, round(sum(n) over (order by rank) / (select count(*) from bearing), 6) as share from hits"))
def _(t: Tables) -> DataFrame:
    bearing = table(t.bearing(), "bearing")
    n = table(bearing.join(_judged(t, bearing), ["query", "document"]).groupBy("rank").agg(F.count("*").alias("n")), "ranks")
    upto = records.running_total(n, "n", "rank", [], "before")
    return upto.select("rank", F.round((F.col("before") + F.col("n")) / F.lit(bearing.count()), 6).alias("share"))


@query("coverage_pivot", with_("bearing", body="select b.query, bool_and(d.lang = 'en') as en, bool_and(d.lang = 'de') as de from bearing b join documents d on d.doc_id = b.document group by b.query"))
def _(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("document"), "lang")
    return t.bearing().join(d, "document").groupBy("query").agg(F.bool_and(F.col("lang") == "en").alias("en"), F.bool_and(F.col("lang") == "de").alias("de"))


@query("chunk_split", """with p as (select doc_id, string_split(text, chr(10)) as parts from documents), r as (select doc_id, unnest(parts) as part, unnest(range(len(parts))) as k from p)
 select doc_id, row_number() over (partition by doc_id order by k) as position, length(part) as size from r where trim(part) <> ''""")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "part")).where("trim(part) <> ''")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")).cast("long").alias("position"), F.length("part").cast("long").alias("size"))


@query("heading_chunks", """with s as (select doc_id, unnest(string_split(chr(10) || text, chr(10) || 'The ')) as part, generate_subscripts(string_split(chr(10) || text, chr(10) || 'The '), 1) as k from documents),
 p as (select doc_id, k, case when k > 1 then 'The ' || part else part end as part from s)
 select doc_id, row_number() over (partition by doc_id order by k) as position, 'Document ' || doc_id || chr(10) || chr(10) || regexp_replace(regexp_replace(part, '^\\s+', ''), '\\s+$', '') as text from p where regexp_matches(part, '\\S')""")
def _(t: Tables) -> DataFrame:
    chunks = retrieval.heading_chunks(t.documents, "doc_id", "text", F.concat(F.lit("Document "), F.col("doc_id").cast("string")), "The ")
    return chunks.select("doc_id", F.col("position").cast("long").alias("position"), "text")


@query("chunk_report", "select count(*) as chunks, round(avg(length(text)), 4) as mean_size, max(length(text)) as longest, arg_max(doc_id, length(text) * 1000000 + doc_id) as longest_id, cast(sum((length(text) + 3) // 4) as bigint) as tokens from documents")
def _(t: Tables) -> DataFrame:
    n = F.length("text").cast("long")
    return t.documents.agg(F.count("*").alias("chunks"), F.round(F.avg(n), 4).alias("mean_size"), F.max(n).alias("longest"), F.max_by("doc_id", n * 1000000 + F.col("doc_id")).alias("longest_id"), F.sum(F.floor((n + 3) / 4)).cast("long").alias("tokens"))


@query("corpus_fingerprint", """with leaves as (select source, doc_id // 1024 as part, sha256(string_agg(md5(text), chr(0) order by doc_id)) as h from documents group by source, doc_id // 1024)
 select source, sha256(string_agg(h, chr(0) order by part)) as fingerprint from leaves group by source""")
def _(t: Tables) -> DataFrame:
    # in two levels, so that a source with a large share of all documents isn't gathered row by row
    leaves = t.documents.groupBy("source", F.floor(F.col("doc_id") / 1024).alias("part")).agg(ordered_fingerprint(F.md5("text"), F.col("doc_id")).alias("h"))
    return leaves.groupBy("source").agg(ordered_fingerprint(F.col("h"), F.col("part")).alias("fingerprint"))


@query("stable_ids", "select doc_id, 'node_' || substr(sha256(source || chr(0) || coalesce(lang, '') || chr(0) || doc_id), 1, 24) as id from documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", stable_id("node", F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"))


SYNC = """want as (select doc_id as chunk, md5(text) as digest from documents where doc_id % 7 <> 0), have as (select doc_id as chunk, case when doc_id % 5 = 0 then 'old' else md5(text) end as digest from documents where doc_id % 3 <> 0)"""


@query("index_sync_plan", with_(SYNC, body="select chunk, case when w.digest is null then 'drop' when h.digest is null then 'add' when w.digest <> h.digest then 'replace' else 'keep' end as action from want w full join have h using (chunk)"))
def _(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("chunk"), F.md5("text").alias("digest"))
    stored = d.where("chunk % 3 <> 0").withColumn("digest", F.when(F.col("chunk") % 5 == 0, "old").otherwise(F.col("digest")))
    return retrieval.sync_plan(d.where("chunk % 7 <> 0"), stored)


@query("coverage_audit", with_(SYNC, body="select count(*) filter (h.chunk is null) as missing, count(*) filter (w.chunk is null) as extra, count(*) filter (w.chunk is not null and h.chunk is not null) as covered from want w full join have h on w.chunk = h.chunk"))
def _(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("chunk"), F.md5("text").alias("digest"))
    plan = retrieval.sync_plan(d.where("chunk % 7 <> 0"), d.where("chunk % 3 <> 0"))
    return plan.agg(F.count(F.when(F.col("action") == "add", 1)).alias("missing"), F.count(F.when(F.col("action") == "drop", 1)).alias("extra"), F.count(F.when(F.col("action").isin("keep", "replace"), 1)).alias("covered"))


@query("query_text", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id")
def _(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


@query("random_baseline", "select item_id as query, document, row_number() over (partition by item_id order by sha256('seed' || chr(0) || item_id || chr(0) || document)) as rank from benchmark cross join (select distinct label as document from embeddings)")
def _(t: Tables) -> DataFrame:
    return retrieval.random_ranking(t.benchmark.select(F.col("item_id").alias("query")), t.embeddings.select(F.col("label").alias("document")).distinct(), "seed")

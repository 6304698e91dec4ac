"""Policies and sources read by table functions and by DataFrame operators, each with SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import table_functions
from lattica.functions.storage import session_dir
from lattica.operators import report
from lattica.plans.fixtures import Tables
from lattica.plans.record_queries import _sources
from lattica.plans.registry import registry
from lattica.sources import policy_text, python_code, tree

QUERIES, ORACLES, query = registry()

SECTIONS = "".join(f"## {s.capitalize()}\n{{}}\n" if s == "exceptions" else f"##  {s.capitalize()} \nsays {s}\n" for s in policy_text.SECTIONS)


def _texts(t: Tables) -> DataFrame:
    """A policy text for every document: YAML with comments, quotes, folded texts and lists over lines."""
    k = F.col("doc_id")
    scope = F.when(k % 4 == 0, "scope: user\napplies_to: ' ada '\n").when(k % 29 == 1, "scope: user\n").when(k % 31 == 1, "scope: everywhere\n").otherwise("scope: general # all\n")
    front = F.concat(
        F.lit("# a comment\nid: p"), F.when(k % 50 == 7, F.lit(7)).otherwise(k), F.lit("\ntitle: 'It''s "), "lang", F.lit("'\ndescription: >-\n  folded\n  over lines\n"), scope,
        F.lit("strength: \"guidance\"\n"), F.when(k % 37 == 2, F.lit("tags: none\n")).otherwise(F.concat(F.lit("tags:\n  - "), "lang", F.lit("\n  - \"a, b\" # two words\n"))), F.lit("source:\n  author: "), "source", F.lit("\n  inspiration: [x, 'y: z']\n"),
    )
    before, after = SECTIONS.split("{}")
    body = F.concat(F.lit(before), F.when(k % 13 == 5, "").otherwise("none known"), F.lit(after), F.when(k % 17 == 3, F.lit("## INTENT\nagain\n")).otherwise(""))
    text = F.when(k % 41 == 6, F.lit("no front matter")).otherwise(F.concat(F.lit("---\n"), front, F.lit("---\n"), body))
    return t.documents.select(F.concat(F.lit("p/"), k, F.lit(".md")).alias("path"), text.alias("text"))


POLICIES = """with k as (select doc_id as k, lang, source from documents),
 f as (select *, case when k % 41 = 6 then 'no front matter' when k % 4 <> 0 and k % 29 <> 1 and k % 31 = 1 then 'unknown scope' when k % 4 <> 0 and k % 29 = 1 then 'user policies say to whom they apply'
   when k % 37 = 2 then 'tags are no list of texts' when k % 17 = 3 then 'a section twice: INTENT' when k % 13 = 5 then 'empty: exceptions' end as fault, case when k % 50 = 7 then 7 else k end as n from k)
 select 'p/' || k || '.md' as path, case when k % 41 <> 6 then 'p' || n end as id, case when k % 41 <> 6 then 'It''s ' || lang end as title, case when k % 41 <> 6 then 'folded over lines' end as description,
  case when fault is not null then null when k % 4 = 0 then 'ada' end as applies_to, case when fault is null then lang || '/a, b' end as tags, case when fault is null then source end as author,
  case when fault is null then 9 end as sections, coalesce(fault, case when count(*) filter (k % 41 <> 6) over (partition by n) > 1 then 'an id twice' end) as error from f"""


def _said(rows: DataFrame) -> DataFrame:
    fine = F.coalesce(F.col("error") == "an id twice", F.lit(True))
    return rows.select(
        "path", "id", "title", "description", F.when(fine, F.col("applies_to")).alias("applies_to"), F.when(fine, F.array_join("tags", "/")).alias("tags"), F.when(fine, F.col("author")).alias("author"),
        F.when(fine, F.size("sections")).alias("sections"), "error",
    )


@query("policy_documents", POLICIES)
def _(t: Tables) -> DataFrame:
    return _said(policy_text.policies(_texts(t)))


def _dealt(files: DataFrame) -> DataFrame:
    """``files`` in several parts a core: a small table may be one split, and table functions take long for each row."""
    return files.repartition(python_code.TASKS * max(files.sparkSession.sparkContext.defaultParallelism, 1), "path")


@query("lateral_policies", POLICIES)
def _(t: Tables) -> DataFrame:
    table_functions.register(t.spark)
    _dealt(_texts(t)).createOrReplaceTempView("policy_files")
    return _said(policy_text.with_duplicates(t.spark.sql("select f.path, p.* from policy_files f, lateral read_policy(f.path, f.text) p")))


@query("lateral_symbols", """with k as (select s_suppkey as k from supplier) select 'pkg/mod' || k || '.py' as path, 'FUNCTION' as node_type, 3 as symbols, 3 as first_line from k
 union all select 'tests/test_mod' || k || '.py', 'TEST_FUNCTION', 1, 3 from k union all select 'pkg/port' || k || '.py', 'INTERFACE', 1, 3 from k union all select 'pkg/port' || k || '.py', 'METHOD', 2, 4 from k
 union all select 'pkg/disk' || k || '.py', 'CLASS', 3, 1 from k union all select 'pkg/disk' || k || '.py', 'METHOD', 3, 2 from k union all select 'conf' || k || '/settings.py', 'FUNCTION', 1, 4 from k""")
def _(t: Tables) -> DataFrame:
    table_functions.register(t.spark)
    _dealt(_sources(t)).createOrReplaceTempView("source_files")
    return t.spark.sql("""select f.path, r.node_type, cast(count(*) as int) as symbols, min(r.line) as first_line
      from source_files f, lateral parse_python(f.path, f.source) r where r.kind = 'symbol' group by f.path, r.node_type""")


@query("label_documents", """with c as (select distinct o_custkey as c from orders), f as (select c, case when c % 7 = 0 then 'no bearing policy' when c % 10 = 1 then 'a candidate twice' end as error from c)
 select 'r' || c as repository, 'a' || c || '|b' as participants, case when c % 7 = 0 then '' else 'p1,q' || c end as bearing, case when c % 3 = 0 then 'x y' else '' end as supporting, error
 from f, range(2) k(k) where k = 0 or error = 'a candidate twice'""")
def _(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    case = F.concat(F.lit("  - repository: r"), c, F.lit("\n    participants: [b, a"), c, F.lit("]\n"), F.when(c % 7 != 0, F.concat(F.lit("    bearing:\n      - q"), c, F.lit("\n      - p1\n"))).otherwise(""), F.when(c % 3 == 0, "    supporting: ['x y']\n").otherwise(""))
    text = F.concat(F.lit("# labels\ncases:\n"), case, F.when((c % 10 == 1) & (c % 7 != 0), case).otherwise(""))
    rows = policy_text.label_lists(t.orders.select("o_custkey").distinct().select(text.alias("text")))
    return rows.select("repository", *[F.array_join(x, by).alias(x) for x, by in (("participants", "|"), ("bearing", ","), ("supporting", ","))], "error")


def _written(files: DataFrame, root: str) -> None:
    """Files (path, source) in a folder that driver and executors share, one task per part of the rows."""

    def write(rows) -> None:
        for r in rows:
            at = os.path.join(root, r.path)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                f.write(r.source)

    files.foreachPartition(write)


@query("tree_symbols", """with k as (select s_suppkey as k from supplier), s as (select 'pkg/mod' || k || '.py' as path, 'FUNCTION' as node_type, 3 as symbols from k union all select 'pkg/port' || k || '.py', 'INTERFACE', 1 from k union all select 'pkg/port' || k || '.py', 'METHOD', 2 from k
 union all select 'pkg/disk' || k || '.py', 'CLASS', 3 from k union all select 'pkg/disk' || k || '.py', 'METHOD', 3 from k) select * from s where path < 'pkg/port5'""")
def _(t: Tables) -> DataFrame:
    base = session_dir(t.spark)
    if not base.startswith("file:") and "://" in base:
        raise ValueError("a tree is read from a folder that all machines mount")
    root = os.path.join("/" + base.removeprefix("file:").lstrip("/"), f"tree-{uuid.uuid4().hex}")
    _written(_sources(t), root)
    tree.register(t.spark)
    files = t.spark.read.format("source_tree").option("exclude", "tests").load(root).where(F.col("path").startswith("pkg/") & (F.col("path") < "pkg/port5"))
    symbols = python_code.parse(files).where("kind = 'symbol'")
    return symbols.groupBy("path", "node_type").agg(F.count("*").cast("int").alias("symbols"))


REPORT = """with o as (select o_custkey as r, 'f' || o_orderkey as finding, case o_orderstatus when 'F' then 'material' when 'O' then 'held' else 'cleared' end as verdict, o_orderpriority as p, o_orderkey, cast(floor(o_totalprice) as bigint) as price, c_name, c_mktsegment, c_nationkey
   from orders join customer on c_custkey = o_custkey),
 v as (select r, any_value(c_name) as name, any_value(c_mktsegment) as segment, any_value(c_nationkey) as nation, count(*) as n, count(*) filter (verdict = 'material') as material, count(*) filter (verdict = 'held') as held, count(*) filter (verdict = 'cleared') as cleared,
   count(*) filter (p in ('1-URGENT', '2-HIGH')) as moved, count(*) filter (p = '3-MEDIUM') as addressed, case when r % 3 = 0 then null else r % 7 + 1 end as previous from o group by r),
 lines as (
  select r, 1 as ordinal, 'Review' as heading, '0' as position, name || ', review ' || (coalesce(previous, 0) + 1) as line from v
  union all select r, 1, 'Review', '1', 'Not final: it waits for answers.' from v where r % 2 = 0
  union all select r, 1, 'Review', '2', n || case when n = 1 then ' candidate' else ' candidates' end || ' judged: ' || material || ' material, ' || held || ' held, ' || cleared || ' cleared.' || coalesce(' ' || moved || ' moved since review ' || previous || ', ' || addressed || ' addressed.', '') from v
  union all select r, 2, 'Material (' || material || ')', '0', 'Evidence supports a concern worth acting on.' from v where material > 0
  union all select r, 2, 'Material (' || material || ')', '1' || finding, finding || ': ' || price from o join v using (r) where verdict = 'material'
  union all select r, 3, 'Held (' || held || ')', '0', 'Waits on what the sources cannot tell.' from v where held > 0
  union all select r, 3, 'Held (' || held || ')', '1' || finding, finding || ': ' || price from o join v using (r) where verdict = 'held'
  union all select r, 4, 'Cleared (' || cleared || ')', '0', 'Looked at and found to be no problem.' from v where cleared > 0
  union all select r, 4, 'Cleared (' || cleared || ')', '1' || finding, finding || ': ' || price from o join v using (r) where verdict = 'cleared'
  union all select r, 5, 'What could not be seen', verdicts || chr(0) || lim, verdicts || ': ' || lim from (select r, lim, array_to_string(list_sort(list(distinct verdict)), ', ') as verdicts from (select r, verdict, unnest(['static only', p]) as lim from o) group by r, lim)
  union all select r, 6, 'What moved', case when p in ('1-URGENT') then '0' when p = '2-HIGH' then '1' else '2' end || finding, case p when '1-URGENT' then 'new' when '2-HIGH' then 'changed' else 'addressed' end || ': ' || finding || case when p = '2-HIGH' then ' (SHAPE)' else '' end from o join v using (r) where p < '4' and previous is not null
  union all select r, 6, 'What moved', '', case when previous is null then 'The first review: all is new, and there is nothing to compare it with.' end from v
  union all select r, 7, case when r % 2 = 0 then 'Open questions' else 'Left unanswered' end, 'why ' || finding, 'why ' || finding || ' (intent)' from o where p = '4-NOT SPECIFIED'
  union all select r, 8, 'Judged against', 'who ' || finding, 'who ' || finding || ': ' || case when o_orderkey % 2 = 0 then 'team' else 'skipped' end || ' (user)' from o where p = '5-LOW'
  union all select r, 9, 'Where this comes from', s, s from (select r, unnest([segment, 'nation ' || nation]) as s from v)),
 every as (select r, ordinal, heading, position, line from lines union all select r, k, case k when 5 then 'What could not be seen' when 8 then 'Judged against' else 'Where this comes from' end, '', null from v, (select unnest([5, 8, 9]) as k)),
 parts as (select r, ordinal, '## ' || heading || chr(10) || chr(10) || coalesce(string_agg('- ' || line, chr(10) order by position, line) filter (line is not null), 'None.') as text from every group by r, ordinal, heading)
 select r as repository, '# Report' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by ordinal, text) || chr(10) as report from parts group by r"""


@query("review_report", REPORT)
def _(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("repository"), F.concat(F.lit("f"), "o_orderkey").alias("finding"), "o_orderkey", F.col("o_orderpriority").alias("p"), F.when(F.col("o_orderstatus") == "F", "material").when(F.col("o_orderstatus") == "O", "held").otherwise("cleared").alias("verdict"), F.floor("o_totalprice").cast("string").alias("summary"))
    r = F.col("repository")
    previous = F.when(r % 3 != 0, r % 7 + 1)
    sources = F.array("c_mktsegment", F.concat(F.lit("nation "), "c_nationkey"))
    reviews = t.customer.select(F.col("c_custkey").alias("repository"), F.col("c_name").alias("name"), sources.alias("sources")).join(o.select("repository").distinct(), "repository", "left_semi")
    reviews = reviews.select("*", (F.coalesce(previous, F.lit(0)) + 1).alias("sequence"), previous.alias("previous"), (r % 2 == 0).alias("waiting"))
    state = F.when(F.col("p") == "1-URGENT", "new").when(F.col("p") == "2-HIGH", "changed").when(F.col("p") == "3-MEDIUM", "addressed").otherwise("unchanged")
    moves = o.select("repository", "finding", state.alias("state"), F.when(F.col("p") == "2-HIGH", "SHAPE").alias("causes"))
    findings = o.select("repository", "finding", "verdict", "summary", F.array(F.lit("static only"), F.col("p")).alias("limits"))
    questions = o.where("p = '4-NOT SPECIFIED'").select("repository", F.concat(F.lit("why "), "finding").alias("question"), F.lit("intent").alias("facet"))
    answers = o.where("p = '5-LOW'").select("repository", F.concat(F.lit("who "), "finding").alias("question"), F.when(F.col("o_orderkey") % 2 == 0, "team").alias("value"), F.lit("user").alias("actor"))
    return report.markdown_report(report.review_sections(reviews, findings, moves, questions, answers))

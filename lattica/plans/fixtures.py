"""Graph, corpus and record views over the driver's tables, in Spark and as DuckDB views' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.storage import table
from lattica.operators import retrieval


class Tables:
    """Tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        """node, node_type, name, parent, is_public: region > nation > customer and supplier."""
        r = self.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("node"), F.lit("PACKAGE_ROOT").alias("node_type"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_public"))
        n = self.nation.select(F.concat(F.lit("n:"), "n_nationkey"), F.lit("PACKAGE"), "n_name", F.concat(F.lit("r:"), "n_regionkey"), F.lit(True))
        c = self.customer.select(F.concat(F.lit("c:"), "c_custkey"), F.lit("CLASS"), "c_name", F.concat(F.lit("n:"), "c_nationkey"), F.when(F.col("c_acctbal") < 0, F.lit(False)).when(F.col("c_acctbal") > 5000, F.lit(True)))
        s = self.supplier.select(F.concat(F.lit("s:"), "s_suppkey"), F.lit("MODULE"), "s_name", F.concat(F.lit("n:"), "s_nationkey"), F.lit(True))
        return r.union(n).union(c).union(s)

    def contains(self) -> DataFrame:
        return self.nodes().where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"))

    def _strongest(self, pairs: DataFrame, by: str, share: float) -> DataFrame:
        """Of all pairs (src, dst, quantity) the sums, those of at least ``share`` of the largest of the same ``by``."""
        total = pairs.groupBy("src", "dst").agg(F.sum("quantity").alias("total"))
        most = total.groupBy(by).agg((F.max("total") * share).alias("least"))
        return total.join(most, by).where("total >= least").select("src", "dst")

    def _follows(self, share: float) -> DataFrame:
        """Edges to the suppliers whose lines follow a supplier's own in orders, by the quantity of both lines:
        the strongest, and those of at least ``share`` (0.8 or more) of it. All lines count.

        They are gone through once for all views of a query: what is kept of the sums is a table.
        """
        if "kept" not in self.__dict__:
            w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
            l = self.lineitem.withColumn("next_supp", F.lead("l_suppkey").over(w)).withColumn("next_qty", F.lead("l_quantity").over(w))
            l = l.where(F.col("l_suppkey") != F.col("next_supp"))
            total = l.groupBy("l_suppkey", "next_supp").agg(F.sum(F.col("l_quantity") + F.col("next_qty")).alias("total"))
            most = total.groupBy("l_suppkey").agg(F.max("total").alias("most"))
            kept = total.join(most, "l_suppkey").where(F.col("total") >= F.col("most") * 0.8)
            self.kept = table(kept.select(F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.concat(F.lit("s:"), "next_supp").alias("dst"), "total", "most"), "follows")
        return self.kept.where(F.col("total") >= F.col("most") * share).select("src", "dst")

    def deps(self) -> DataFrame:
        return self._follows(0.95)

    def calls(self) -> DataFrame:
        return self._follows(0.8)

    def targets(self) -> DataFrame:
        """(node, target): parts of a supplier whose line follows another, as the symbols that calls meet."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
        l = self.lineitem.select(*(F.lead(c).over(w).alias(f"next_{c[2:]}") for c in ("l_suppkey", "l_partkey"))).where("next_suppkey is not null")
        node = F.concat(F.lit("s:"), "next_suppkey")
        return l.select(node.alias("node"), F.concat_ws("/", node, "next_partkey").alias("target")).distinct()

    def links(self) -> DataFrame:
        """(src, dst, edge_type): calls of every fifth supplier are tests, edges of every third implement, of every seventh configure."""
        k = F.substring("src", 3, 20).cast("long")
        kinds = ((self.calls(), 5, "TESTS"), (self.deps(), 3, "IMPLEMENTS"), (self.deps(), 7, "CONFIGURES"))
        first, *rest = (e.where(k % n == 0).withColumn("edge_type", F.lit(kind)) for e, n, kind in kinds)
        for e in rest:
            first = first.unionByName(e)
        return first

    def impl(self) -> DataFrame:
        """Suppliers implement the parts of which they sell the most, or 0.95 of that."""
        l = self.lineitem.select(F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"), F.col("l_quantity").alias("quantity"))
        return self._strongest(l, "dst", 0.95)

    def modules(self) -> DataFrame:
        return self.nodes().where("node_type = 'MODULE'").select("node")

    def constants(self) -> DataFrame:
        return self.documents.select(F.col("source").alias("module"), F.element_at(F.split("text", "\n"), 1).alias("name"), F.md5("text").alias("fingerprint"))

    def policies(self) -> DataFrame:
        k = F.col("document")
        d = self.embeddings.select(F.col("label").alias("document")).distinct()
        scope = F.when(k < 4, "general").when(k == 4, "user").when(k == 5, "organisation").when(k == 6, "repository").otherwise("adr")
        to = F.when(k == 4, "ada").when(k == 5, "acme").when(k == 6, "shop").when(k == 7, "other")
        return d.select("document", scope.alias("scope"), F.when(k == 1, "required").otherwise("advised").alias("strength"), to.alias("applies_to"))

    def bearing(self) -> DataFrame:
        """(query, document, grade): documents that hold a benchmark item.

        An item's words between its first and last stand in such a document as they are, so three
        of them in a row are a seed that both are joined on; only items of fewer words are compared
        with every document.
        """
        b = self.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("item")).withColumn("words", F.split("item", " "))
        d = self.documents.select(F.col("doc_id").alias("document"), "text", "lang")
        seeds = b.where("size(words) >= 5").select("query", "item", F.array_join(F.slice("words", 2, 3), " ").alias("seed"))
        near = retrieval.holders(d, seeds).where(F.contains("text", "item"))
        short = d.join(b.where("size(words) < 5").select("query", "item"), F.contains("text", "item"))
        rows = near.select("query", "document", "lang").unionByName(short.select("query", "document", "lang"))
        return rows.select("query", "document", F.when(F.col("lang") == "en", 3).otherwise(2).alias("grade"))


#: DuckDB views of the same, as common table expressions
SQL = {
    "nodes": """nodes as (
  select 'r:'||r_regionkey as node, 'PACKAGE_ROOT' as node_type, r_name as name, cast(null as varchar) as parent, true as is_public from region
  union all select 'n:'||n_nationkey, 'PACKAGE', n_name, 'r:'||n_regionkey, true from nation
  union all select 'c:'||c_custkey, 'CLASS', c_name, 'n:'||c_nationkey, case when c_acctbal < 0 then false when c_acctbal > 5000 then true end from customer
  union all select 's:'||s_suppkey, 'MODULE', s_name, 'n:'||s_nationkey, true from supplier)""",
    "contains": "contains as (select parent as src, node as dst from nodes where parent is not null)",
    "follows": """follows as (select l_suppkey, l_quantity, lead(l_suppkey) over w as next_supp, lead(l_quantity) over w as next_qty, lead(l_partkey) over w as next_part from lineitem
  window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)),
 strength as (select 's:'||l_suppkey as src, 's:'||next_supp as dst, sum(l_quantity + next_qty) as total from follows where l_suppkey <> next_supp group by 1, 2)""",
    "deps": "deps as (select src, dst from strength qualify total >= 0.95 * max(total) over (partition by src))",
    "calls": "calls as (select src, dst from strength qualify total >= 0.8 * max(total) over (partition by src))",
    "targets": "targets as (select distinct 's:'||next_supp as node, 's:'||next_supp||'/'||next_part as target from follows where next_supp is not null)",
    "links": """links as (select src, dst, 'TESTS' as edge_type from calls where cast(substr(src, 3) as bigint) % 5 = 0
  union all select src, dst, 'IMPLEMENTS' from deps where cast(substr(src, 3) as bigint) % 3 = 0 union all select src, dst, 'CONFIGURES' from deps where cast(substr(src, 3) as bigint) % 7 = 0)""",
    "impl": """impl as (select src, dst from (select 's:'||l_suppkey as src, 'p:'||l_partkey as dst, sum(l_quantity) as total from lineitem group by 1, 2)
  qualify total >= 0.95 * max(total) over (partition by dst))""",
    "modules": "modules as (select node from nodes where node_type = 'MODULE')",
    "constants": "constants as (select source as module, string_split(text, chr(10))[1] as name, md5(text) as fingerprint from documents)",
    "policies": """policies as (select document,
  case when document < 4 then 'general' when document = 4 then 'user' when document = 5 then 'organisation' when document = 6 then 'repository' else 'adr' end as scope,
  case when document = 1 then 'required' else 'advised' end as strength,
  case document when 4 then 'ada' when 5 then 'acme' when 6 then 'shop' when 7 then 'other' end as applies_to
  from (select distinct label as document from embeddings))""",
    "bearing": "bearing as (select item_id as query, doc_id as document, case when lang = 'en' then 3 else 2 end as grade from benchmark b join documents d on contains(d.text, b.text))",
    "reach": """reach as (select src as start, dst as node from deps union select r.start, d.dst from reach r join deps d on d.src = r.node)""",
}


def with_(*names: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(SQL.get(n, n) for n in names) + "\n" + body

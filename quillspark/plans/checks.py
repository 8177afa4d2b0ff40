"""Document checks: shared sections, template removal, people, roll-up of findings, evidence clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table


@query("SELECT risk, count(*) AS pairs, sum(shared)::BIGINT AS shared, max(shared) AS most FROM (SELECT shared, CASE WHEN shared >= 5 THEN 'high' WHEN shared >= 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT a.l_orderkey AS l, b.l_orderkey AS r, count(DISTINCT a.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2)) GROUP BY ROLLUP (risk)")
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parties by how much they share, with a total row."""
    x = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").distinct()
    pairs = x.alias("a").join(x.alias("b"), F.expr("a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey and a.l_orderkey < b.l_orderkey"))
    shared = pairs.groupBy("a.l_orderkey", "b.l_orderkey").agg(F.countDistinct("a.l_partkey").alias("shared"))
    level = F.when(F.col("shared") >= 5, "high").when(F.col("shared") >= 3, "medium").otherwise("low")
    return shared.select("shared", level.alias("risk")).rollup("risk").agg(F.count("*").alias("pairs"), F.sum("shared").alias("shared"), F.max("shared").alias("most"))


@query("SELECT l.doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l WHERE length(line) >= 10 AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = l.line) GROUP BY l.doc_id")
def template_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not stand in the template corpus."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.char_length("line") >= 10)
    known = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("h")).distinct()
    return line.withColumn("h", F.sha2("line", 256)).join(known, "h", "left_anti").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT d.doc_id, s.n AS shared_lines, s.n::DOUBLE / greatest(1, least(d.n, d.n)) AS overlap FROM (SELECT doc_id, count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1) d JOIN (SELECT doc_id, count(DISTINCT l.line) AS n FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) l JOIN (SELECT line FROM (SELECT DISTINCT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(*) > 1) k ON l.line = k.line GROUP BY 1) s ON d.doc_id = s.doc_id")
def section_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a document's distinct lines that occur in more than one source."""
    line = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).withColumn("h", F.sha2("line", 256)).drop("line").distinct()
    shared = line.groupBy("h").agg((F.min("source") != F.max("source")).alias("both")).where("both").select("h", F.lit(1).alias("hit"))
    out = line.join(shared, "h", "left").groupBy("doc_id").agg(F.count("hit").alias("shared_lines"), F.count("*").alias("n")).where("shared_lines > 0")
    return out.select("doc_id", "shared_lines", (F.col("shared_lines") / F.greatest(F.lit(1), F.col("n"))).alias("overlap"))


@query("WITH s AS (SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars < 500) AS short FROM documents GROUP BY ALL) SELECT source, count(*) AS checks, max(CASE WHEN short * 4 > n THEN 2 WHEN short > 0 THEN 1 ELSE 0 END) AS worst FROM s GROUP BY source")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each check of a party, folded to the party's worst."""
    s = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 500).alias("short"))
    finding = F.when(F.col("short") * 4 > F.col("n"), 2).when(F.col("short") > 0, 1).otherwise(0)
    return s.groupBy("source").agg(F.count("*").alias("checks"), F.max(finding).alias("worst"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html)::INTEGER AS chars FROM pages")
def pages_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.char_length("html").alias("chars"))

"""Window operators: sequences, runs, ranges, carry-forward, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table


def islands(df: DataFrame, keys: list[str], order: list[str], starts) -> DataFrame:
    """Numbers the runs of rows within keys; `starts` is true where a new run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_s", F.coalesce(starts.cast("int"), F.lit(1))).withColumn("island", F.sum("_s").over(w)).drop("_s")


def coalesced(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merges ranges that overlap or are adjacent (start <= largest end so far + 1). Nulls come last and join what is open; a
    reversed range that nothing before reaches stands alone, each copy of it too. Equal ranges come in the order of the largest
    end before them, so that of copies the one that opens a merged range comes first."""
    order = [F.asc_nulls_last(start), F.asc_nulls_last(end)]
    of = Window.partitionBy(*keys)
    r = ranges.withColumn("_m", F.max(end).over(of.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_s", F.coalesce(F.col(start) > F.col("_m") + 1, F.col("_m").isNull()).cast("int"))
    r = r.withColumn("island", F.sum("_s").over(of.orderBy(*order, F.asc_nulls_first("_m")).rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


@query("SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN o_custkey || '-' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS name FROM orders")
def count_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(n > 1, F.concat_ws("-", "o_custkey", "o_orderkey")).otherwise(F.col("o_custkey").cast("string")).alias("name"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq FROM conversations")
def sentence_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("seq"))


@query("WITH p AS (SELECT a.l_orderkey, a.l_linenumber AS l, b.l_linenumber AS r FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber), q AS (SELECT *, lag(l) OVER w AS pl, lag(r) OVER w AS pr FROM p WINDOW w AS (PARTITION BY l_orderkey, r - l ORDER BY l)), s AS (SELECT *, sum(CASE WHEN l = pl + 1 AND r = pr + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey, r - l ORDER BY l) AS run FROM q) SELECT l_orderkey, min(l) AS left_start, min(r) AS right_start, count(*) AS length FROM s GROUP BY l_orderkey, r - l, run HAVING count(*) >= 2")
def matched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive matches in which both sides advance by one."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    p = x.alias("a").join(x.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_returnflag = b.l_returnflag and a.l_linenumber < b.l_linenumber")).selectExpr("a.l_orderkey as l_orderkey", "a.l_linenumber as l", "b.l_linenumber as r", "b.l_linenumber - a.l_linenumber as d")
    w = Window.partitionBy("l_orderkey", "d").orderBy("l")
    runs = islands(p, ["l_orderkey", "d"], ["l"], ~((F.col("l") == F.lag("l").over(w) + 1) & (F.col("r") == F.lag("r").over(w) + 1)))
    return runs.groupBy("l_orderkey", "d", "island").agg(F.min("l").alias("left_start"), F.min("r").alias("right_start"), F.count("*").alias("length")).where("length >= 2").drop("d", "island")


@query("WITH r AS (SELECT l_suppkey, CAST(l_partkey AS BIGINT) AS s, CAST(l_partkey + l_linenumber AS BIGINT) AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r), i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT l_suppkey, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY l_suppkey, g")
def coalesce_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_linenumber")).cast("long").alias("e"))
    return coalesced(r, ["l_suppkey"], "s", "e")


@query("SELECT l_suppkey, CAST(unnest(range(s + 1, nxt)) AS BIGINT) AS missing FROM (SELECT l_suppkey, s, lead(s) OVER (PARTITION BY l_suppkey ORDER BY s) AS nxt FROM (SELECT DISTINCT l_suppkey, CAST(l_linenumber * 3 + l_suppkey % 2 AS BIGINT) AS s FROM lineitem WHERE l_linenumber <> 4)) WHERE nxt > s + 1")
def serial_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").where("l_linenumber <> 4").selectExpr("l_suppkey", "cast(l_linenumber * 3 + l_suppkey % 2 as bigint) as s").distinct()
    g = s.withColumn("nxt", F.lead("s").over(Window.partitionBy("l_suppkey").orderBy("s"))).where("nxt > s + 1")
    return g.select("l_suppkey", F.explode(F.sequence(F.col("s") + 1, F.col("nxt") - 1)).alias("missing"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS s, CAST(round(l_quantity + l_tax * 100 - 2) AS BIGINT) AS e FROM lineitem), n AS (SELECT *, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber)) SELECT l_orderkey, l_linenumber, CASE WHEN e < s THEN 'reversed' WHEN ns = s AND ne = e THEN 'duplicate' WHEN ns < e THEN 'overlap' WHEN ns > e + 1 THEN 'gap' ELSE 'ok' END AS finding FROM n")
def range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as s", "cast(round(l_quantity + l_tax * 100 - 2) as bigint) as e")
    w = Window.partitionBy("l_orderkey").orderBy("s", "e", "l_linenumber")
    n = r.withColumns({"ns": F.lead("s").over(w), "ne": F.lead("e").over(w)})
    return n.select("l_orderkey", "l_linenumber", F.expr("case when e < s then 'reversed' when ns = s and ne = e then 'duplicate' when ns < e then 'overlap' when ns > e + 1 then 'gap' else 'ok' end").alias("finding"))


@query("SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_quantity > 30 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey ROWS UNBOUNDED PRECEDING) AS carried FROM lineitem")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.last(F.when(F.col("l_quantity") > 30, F.col("l_partkey")), ignorenulls=True).over(w).alias("carried"))


@query("SELECT conv_id, section, count(*) AS n, min(turn) AS first_turn FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM conversations) GROUP BY conv_id, section")
def sectionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading opens a section; what stands before the first is section 0."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, sf_dir, "conversations").withColumn("section", F.sum((F.col("role") == "user").cast("long")).over(w))
    return c.groupBy("conv_id", "section").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("SELECT source, CAST((rn - 1) // 10 AS BIGINT) AS chunk, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY 1, 2")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rn"))
    return d.groupBy("source", F.floor((F.col("rn") - 1) / 10).alias("chunk")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS last_line FROM lineitem WHERE l_returnflag = 'R'")
def next_start_minus1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", (F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("last_line"))


@query("SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near_purchase FROM events")
def neighbor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 4)
    return table(spark, sf_dir, "events").select("event_id", F.max((F.col("event_type") == "purchase").cast("int")).over(w).alias("near_purchase"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk, substring(text, CAST(i * 850 + 1 AS BIGINT), 1000) AS part FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 150) / 850.0) AS BIGINT)))) AS i FROM documents)")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of 1,000 characters, 150 of them shared; the last ends the text."""
    n = F.greatest(F.lit(1), F.ceil((F.char_length("text") - 150) / F.lit(850.0))).cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return d.select("doc_id", "chunk", F.expr("substring(text, chunk * 850 + 1, 1000)").alias("part"))


@query(r"WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, i, line AS w1, line || lead(line) OVER o AS w2, line || lead(line) OVER o || lead(line, 2) OVER o AS w3 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, count(DISTINCT x) AS windows FROM (SELECT doc_id, unnest([w1, w2, w3]) AS x FROM w) WHERE x IS NOT NULL GROUP BY doc_id")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct windows of one to three lines of each document."""
    lines = F.split("text", "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    at = lambda size: F.transform(F.sequence(F.lit(1), F.size("l") - size + 1), lambda i: F.array_join(F.slice("l", i, size), ""))
    of = lambda size: F.when(F.size("l") >= size, at(size)).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", F.size(F.array_distinct(F.concat(of(1), of(2), of(3)))).cast("long").alias("windows"))

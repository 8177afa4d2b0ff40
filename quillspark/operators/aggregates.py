"""Aggregations: conditional counts, roll-ups, lattices, group checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table

#: Statuses from the worst down; an unknown one counts as unclear.
LATTICE = ("fail", "missing", "unclear", "pass")


def severity(status: Column) -> Column:
    """A status as a number that grows with its severity, so that max folds the lattice."""
    out = F.lit(1)
    for i, name in enumerate(LATTICE):
        out = F.when(status == name, len(LATTICE) - 1 - i).otherwise(out)
    return out


def worst(statuses: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in reversed(LATTICE)]), F.max(severity(statuses)) + 1)


#: Stand-ins for review results: a customer's orders as checks with statuses.
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'odd' ELSE CASE WHEN o_totalprice > 200000 THEN 'missing' ELSE 'pass' END END"


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.expr(_STATUS).alias("status"))


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned FROM lineitem GROUP BY l_suppkey")
def cond_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"))


@query("SELECT o_custkey, CASE WHEN n = 0 THEN 0 WHEN d = 0 THEN 1 WHEN d < n THEN 2 ELSE 3 END AS stage FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS d FROM orders GROUP BY o_custkey)")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.countDistinct("o_orderkey"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(n.alias("n"), d.alias("d")).select("o_custkey", F.when(F.col("n") == 0, 0).when(F.col("d") == 0, 1).when(F.col("d") < F.col("n"), 2).otherwise(3).alias("stage"))


@query("SELECT event_id, list_sort(json_keys(props)) AS keys, CAST(len(json_keys(props)) AS INTEGER) AS n FROM events")
def json_keys_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.sort_array(keys).alias("keys"), F.size(keys).alias("n"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers, list_sort(list(DISTINCT l_returnflag)) AS flags, CASE WHEN count(DISTINCT l_suppkey) > 2 THEN 'high' ELSE 'medium' END AS risk FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def entity_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that recur across at least two independent parties."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    return g.where("suppliers >= 2").withColumn("risk", F.when(F.col("suppliers") > 2, "high").otherwise("medium"))


@query("SELECT field, value, count(DISTINCT c_custkey) AS n FROM (SELECT c_custkey, 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 2")
def metadata_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "stack(2, 'segment', c_mktsegment, 'nation', cast(c_nationkey as string)) as (field, value)")
    return rows.groupBy("field", "value").agg(F.countDistinct("c_custkey").alias("n")).where("n >= 2")


@query("SELECT o_orderkey, CAST(round(coalesce(sum(CASE WHEN l_discount < 0.09 THEN l_extendedprice END), 0), 2) AS DOUBLE) AS total, abs(o_totalprice - coalesce(sum(CASE WHEN l_discount < 0.09 THEN l_extendedprice END), 0)) <= 1000 AS agrees FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice")
def sum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against a declared total; items without an amount are skipped."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    total = F.coalesce(F.sum(F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice"))), F.lit(0.0))
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").groupBy("o_orderkey", "o_totalprice").agg(total.alias("t")).select("o_orderkey", F.round("t", 2).alias("total"), (F.abs(F.col("o_totalprice") - F.col("t")) <= 1000).alias("agrees"))


@query("SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_quantity").agg(F.count("*").alias("n")).where("n > 1")


@query(f"SELECT o_orderpriority, count(*) FILTER (s = 'fail') AS fail, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'odd') AS odd, count(*) FILTER (s = 'pass') AS pass FROM (SELECT o_orderpriority, {_STATUS} AS s FROM orders) GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).groupBy("o_orderpriority").pivot("status", ["fail", "missing", "odd", "pass"]).count().na.fill(0)


@query(f"SELECT o_custkey, o_orderpriority, s AS status, count(*) AS n FROM (SELECT o_custkey, o_orderpriority, {_STATUS} AS s FROM orders) GROUP BY GROUPING SETS ((o_custkey, s), (o_orderpriority, s), (s), ())")
def status_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [[F.col(x) for x in xs] for xs in (("o_custkey", "status"), ("o_orderpriority", "status"), ("status",), ())]
    return _reviews(spark, sf_dir).groupingSets(by, "o_custkey", "o_orderpriority", "status").agg(F.count("*").alias("n"))


@query(f"SELECT o_custkey, CASE max(CASE s WHEN 'fail' THEN 3 WHEN 'missing' THEN 2 WHEN 'pass' THEN 0 ELSE 1 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'missing' WHEN 1 THEN 'unclear' ELSE 'pass' END AS verdict FROM (SELECT o_custkey, {_STATUS} AS s FROM orders) GROUP BY 1")
def status_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).groupBy("o_custkey").agg(worst(F.col("status")).alias("verdict"))


@query(f"SELECT o_custkey, count(*) AS total, count(*) FILTER (s = 'pass') AS passed, floor(10000.0 * count(*) FILTER (s = 'pass') / count(*)) / 100 AS score FROM (SELECT o_custkey, {_STATUS} AS s FROM orders) GROUP BY 1")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _reviews(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passed"))
    return g.withColumn("score", F.floor(F.lit(10000.0) * F.col("passed") / F.col("total")) / 100)


@query("SELECT p_brand, count(*) AS n, list_sort(list(DISTINCT p_type)) AS types FROM part GROUP BY p_brand")
def catalog_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("p_type")).alias("types"))


@query("SELECT p_brand, list_sort(list_distinct(flatten(list([p_size, p_size + 1])))) AS sizes, max(p_retailprice) AS top FROM part GROUP BY p_brand")
def group_merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.flatten(F.collect_list(F.array("p_size", F.col("p_size") + 1))).alias("s"), F.max("p_retailprice").alias("top"))
    return g.select("p_brand", F.sort_array(F.array_distinct("s")).alias("sizes"), "top")


@query("SELECT l_partkey, count(DISTINCT CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS n, count(DISTINCT CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) > 1 AS conflict FROM lineitem GROUP BY l_partkey")
def distinct_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct(F.floor(F.col("l_discount") * 100 + 0.5)).alias("n")).withColumn("conflict", F.col("n") > 1)


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS peak, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("peak"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT l_orderkey, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, l_returnflag, sum(l_quantity) AS total, count(*) >= 2 AND count(DISTINCT l_quantity) = 1 AS repeated FROM (SELECT *, sum(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) AS run FROM (SELECT *, CASE WHEN l_returnflag IS NOT DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) THEN 0 ELSE 1 END AS c FROM lineitem)) GROUP BY l_orderkey, run, l_returnflag")
def run_group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of consecutive rows with an equal key, and whether a run repeats one total."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_quantity")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    l = l.withColumn("c", (~F.col("l_returnflag").eqNullSafe(F.lag("l_returnflag").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    g = l.withColumn("run", F.sum("c").over(w)).groupBy("l_orderkey", "run", "l_returnflag")
    return g.agg(F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.sum("l_quantity").alias("total"), ((F.count("*") >= 2) & (F.countDistinct("l_quantity") == 1)).alias("repeated")).drop("run")


#: A line stands in so many documents of a source from which on it is a running header.
RUNNING = 3
_RUNNING = "l AS (SELECT doc_id, source, regexp_replace(unnest(string_split(text, chr(10))), '[^0-9A-Za-z]', '', 'g') AS sig FROM documents)"


@query(f"WITH {_RUNNING}, r AS (SELECT source, sig FROM l WHERE sig <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3) SELECT doc_id, count(*) AS lines FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.sig = l.sig AND r.source IS NOT DISTINCT FROM l.source) GROUP BY doc_id")
def running_header_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left once those are gone whose letters and digits stand in several documents of a source."""
    line = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    line = line.select("doc_id", "source", F.sha2(F.regexp_replace("line", "[^0-9A-Za-z]", ""), 256).alias("sig"))
    per = line.groupBy("source", "sig", "doc_id").agg(F.count("*").alias("n"))  # a hot line is one row of a document
    often = per.where(F.col("sig") != F.sha2(F.lit(""), 256)).groupBy("source", "sig").agg(F.count("*").alias("docs")).where(F.col("docs") >= RUNNING).alias("o")
    p = per.alias("p")
    left = p.join(often, F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.sig") == F.col("o.sig")), "left_anti")
    return left.groupBy("doc_id").agg(F.sum("n").alias("lines"))


def dice(common: Column, left: Column, right: Column) -> Column:
    """Dice's coefficient from counts; 0 if either set is empty."""
    return F.when((left == 0) | (right == 0), 0.0).otherwise(2 * common / (left + right))


def overlap(common: Column, left: Column, right: Column) -> Column:
    return common / F.greatest(F.lit(1), F.least(left, right))


def exact_score(sections: Column, blocks: Column, tables: Column, images: Column, identical: Column) -> Column:
    score = F.least(F.round(0.40 * sections + 0.35 * blocks + 0.20 * tables + 0.05 * images, 4), F.lit(0.9999))
    return F.when(identical, 1.0).otherwise(score)


def exact_risk(identical: Column, score: Column, n_sections: Column, n_blocks: Column, n_tables: Column, n_images: Column, dice: Column) -> Column:
    """The ladder of exact duplicates, from the highest rung down."""
    high = identical | (n_tables >= 2) | (n_images >= 3) | ((score >= 0.35) & (n_sections >= 5))
    medium = (n_sections >= 3) | (n_tables >= 1) | (n_images >= 2) | (n_blocks >= 5) | (dice >= 0.15)
    return F.when(high, "high").when(medium, "medium").when((n_blocks >= 1) | (n_images >= 1), "low").otherwise("none")


def similar_score(sections: Column, blocks: Column, tables: Column) -> Column:
    return F.round(0.45 * sections + 0.35 * blocks + 0.20 * tables, 4)


def similar_risk(exact: Column, score: Column, n_sections: Column, n_blocks: Column, n_tables: Column, block_ratio: Column) -> Column:
    """The ladder of similar units; an exact risk of medium or high stays."""
    high = ((n_tables >= 1) & (n_sections >= 1)) | ((score >= 0.6) & (n_blocks >= 3))
    medium = ((n_sections >= 1) & (n_blocks >= 2)) | (n_tables >= 1) | (block_ratio >= 0.45)
    out = F.when(exact.isin("high", "medium"), exact).when(high, "high").when(medium, "medium")
    return out.when((n_blocks >= 1) | (block_ratio >= 0.3), "low").otherwise(exact)


_SAID = "c AS (SELECT conv_id, role = 'user' AS mine, text FROM conversations), w AS (SELECT conv_id, x, bool_or(mine) AS l, bool_or(NOT mine) AS r FROM (SELECT conv_id, mine, unnest(string_split(text, ' ')) AS x FROM c) WHERE x <> '' GROUP BY ALL), s AS (SELECT conv_id, x, bool_or(mine) AS l, bool_or(NOT mine) AS r FROM (SELECT conv_id, mine, unnest(string_split(text, chr(10))) AS x FROM c) WHERE length(x) >= 8 GROUP BY ALL), b AS (SELECT conv_id, count(*) FILTER (l AND r) AS both_, count(*) FILTER (l) AS nl, count(*) FILTER (r) AS nr FROM w GROUP BY 1), k AS (SELECT conv_id, count(*) FILTER (l AND r) AS both_, count(*) FILTER (l) AS nl, count(*) FILTER (r) AS nr FROM s GROUP BY 1)"


def _sides(spark: SparkSession, sf_dir: str, by: str, least: int) -> DataFrame:
    """What the two sides of a conversation have in common: conv_id, both, nl, nr."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "user").alias("mine"), F.explode(F.split("text", by)).alias("x")).where(F.char_length("x") >= least)
    u = c.groupBy("conv_id", "x").agg(F.bool_or("mine").alias("l"), F.bool_or(~F.col("mine")).alias("r"))
    return u.groupBy("conv_id").agg(F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if("l").alias("nl"), F.count_if("r").alias("nr"))


@query(f"WITH {_SAID} SELECT conv_id, both_ AS common, CASE WHEN nl = 0 OR nr = 0 THEN 0 ELSE 2.0::DOUBLE * both_ / (nl + nr) END AS dice FROM b")
def sentence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sides(spark, sf_dir, " ", 1)
    return s.select("conv_id", F.col("both").alias("common"), dice(F.col("both"), F.col("nl"), F.col("nr")).alias("dice"))


@query(f"WITH {_SAID}, m AS (SELECT b.conv_id, coalesce(k.both_, 0) AS sections, coalesce(k.both_::DOUBLE / greatest(1, least(k.nl, k.nr)), 0) AS o, b.both_ AS blocks, CASE WHEN b.nl = 0 OR b.nr = 0 THEN 0 ELSE 2.0::DOUBLE * b.both_ / (b.nl + b.nr) END AS d FROM b LEFT JOIN k USING (conv_id)), x AS (SELECT *, least(round(0.40::DOUBLE * o + 0.35::DOUBLE * d, 4), 0.9999::DOUBLE) AS score FROM m) SELECT conv_id, score, CASE WHEN score >= 0.35 AND sections >= 5 THEN 'high' WHEN sections >= 3 OR blocks >= 5 OR d >= 0.15 THEN 'medium' WHEN blocks >= 1 THEN 'low' ELSE 'none' END AS risk FROM x")
def pair_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and risk of what two sides share, words as blocks and lines as sections."""
    b, k = _sides(spark, sf_dir, " ", 1), _sides(spark, sf_dir, "\n", 8).select("conv_id", F.col("both").alias("k"), F.col("nl").alias("kl"), F.col("nr").alias("kr"))
    m = b.join(k, "conv_id", "left").select("conv_id", F.coalesce("k", F.lit(0)).alias("sections"), F.coalesce(overlap(F.col("k"), F.col("kl"), F.col("kr")), F.lit(0.0)).alias("o"), F.col("both").alias("blocks"), dice(F.col("both"), F.col("nl"), F.col("nr")).alias("d"))
    no, none = F.lit(False), F.lit(0)
    m = m.withColumn("score", exact_score(F.col("o"), F.col("d"), none, none, no))
    return m.select("conv_id", "score", exact_risk(no, F.col("score"), F.col("sections"), F.col("blocks"), none, none, F.col("d")).alias("risk"))

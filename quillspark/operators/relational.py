"""Scans, filters, joins, set operations, sorts and top-k over the relational core."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table


def clamp_page(limit: int, offset: int, most: int = 200) -> tuple[int, int]:
    """Page bounds as a caller may ask for them: 1 to `most` rows, never a negative start."""
    return max(1, min(most, limit)), max(0, offset)


def all_of(conditions: list[Column]) -> Column:
    """A conjunction of the filters that were asked for; none keeps every row."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def kth_occurrence(left: DataFrame, right: DataFrame, key: str, group: list[str], order: str) -> DataFrame:
    """Pairs the i-th occurrence of a key on the left with its i-th on the right, within groups."""
    number = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy(*group, key).orderBy(order)))
    return number(left).join(number(right).withColumnRenamed(order, f"right_{order}"), [*group, key, "k"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 100000")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_custkey", "o_totalprice")


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """The one row with this value; two are an error, none is an empty result."""
    found = df.where(F.col(column) == value)
    if len(found.select(column).take(2)) > 1:
        raise ValueError(f"{column} = {value!r} names several rows")
    return found


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(table(spark, sf_dir, "customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT doc_id, CAST(p AS BIGINT) AS first_page, CAST(least(p + 999, n_chars) AS BIGINT) AS last_page FROM documents, LATERAL (SELECT unnest(range(1, n_chars + 1, 1000)) AS p)")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("n_chars > 0")
    return d.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_chars"), F.lit(1000).cast("long"))).alias("first_page")).select("doc_id", "first_page", F.least(F.col("first_page") + 999, F.col("n_chars")).alias("last_page"))


@query("SELECT sha256(text) AS digest, list_sort(list(DISTINCT source)) AS sources, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def hash_dedupe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "source")
    return d.groupBy("digest").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count("*").alias("n")).where("n > 1")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') IS NULL AS missing FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").isNull().alias("missing"))


@query("SELECT event_id, user_id, event_type FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as gzip JSON text and back, under a declared schema."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return e.select(F.from_json(F.to_json(F.struct(*e.columns)), e.schema).alias("x")).select("x.*")


@query("SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END) AS quality, l.doc_id IS NOT NULL AS manual FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars").alias("d"), table(spark, sf_dir, "labels").alias("l")
    return d.join(l, F.col("d.doc_id") == F.col("l.doc_id"), "left").select("d.doc_id", F.coalesce("l.quality", F.when(F.col("n_chars") > 1000, 1).otherwise(0)).alias("quality"), F.col("l.doc_id").isNotNull().alias("manual"))


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS role, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_suppkey, s_name, 'supplier', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def union_all_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    of = lambda name, p, key: table(spark, sf_dir, name).join(n, F.col(f"{p}_nationkey") == n.n_nationkey).select(F.col(key).alias("id"), F.col(f"{p}_name").alias("name"), F.lit(name).alias("role"), "n_name")
    return of("customer", "c", "c_custkey").unionByName(of("supplier", "s", "s_suppkey"))


@query("SELECT p_partkey, p_name FROM part WHERE (CAST(p_partkey AS VARCHAR) ILIKE '%7%' OR p_name ILIKE '%RED%') AND p_size > 10")
def keyword_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    keyword = F.col("p_partkey").cast("string").ilike("%7%") | F.col("p_name").ilike("%RED%")
    return p.where(all_of([keyword, F.col("p_size") > 10])).select("p_partkey", "p_name")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE coalesce(c_name, '') ILIKE '%9%' OR coalesce(n_name, '') ILIKE '%9%' OR coalesce(r_name, '') ILIKE '%2%' OR coalesce(c_mktsegment, '') ILIKE '%auto%'")
def multi_col_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    has = [F.coalesce(F.col(x), F.lit("")).ilike(p) for x, p in (("c_name", "%9%"), ("n_name", "%9%"), ("r_name", "%2%"), ("c_mktsegment", "%auto%"))]
    return j.where(reduce(lambda a, b: a | b, has)).select("c_custkey", "n_name", "r_name")


_NULLED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_returnflag END AS flag FROM lineitem"


@query(f"SELECT a.l_orderkey, a.l_linenumber AS left_line, b.l_linenumber AS right_line FROM ({_NULLED}) a JOIN ({_NULLED}) b ON a.l_orderkey = b.l_orderkey AND a.flag IS NOT DISTINCT FROM b.flag AND a.l_linenumber < b.l_linenumber")
def null_safe_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("flag"))
    a, b = x.alias("a"), x.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & F.col("a.flag").eqNullSafe(F.col("b.flag")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))
    return a.join(b, on).select("a.l_orderkey", F.col("a.l_linenumber").alias("left_line"), F.col("b.l_linenumber").alias("right_line"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (1, 7, 42, 99)")
def isin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_custkey").isin(1, 7, 42, 99)).select("o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 40) AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal < 0)")
def anti_join_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row goes if any of its three keys is excluded: three anti-joins, not a disjunction."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = l.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    out = out.join(table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    out = out.join(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_anti")
    return out.select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, c_name, n_name, s.quality FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN labels s ON o_orderkey = s.doc_id AND s.quality = 1")
def star_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, s = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "labels"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(s, (o.o_orderkey == s.doc_id) & (s.quality == 1), "left").select("o_orderkey", "c_name", "n_name", "quality")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(open, 0) AS n_open FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders WHERE o_custkey = c_custkey) ON TRUE")
def lateral_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated aggregate for each row, decorrelated: one aggregation, one join."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return table(spark, sf_dir, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("open", F.lit(0)).alias("n_open"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) ON TRUE")
def lateral_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, list_sort(list(event_type)) AS kinds FROM events GROUP BY user_id")
def explode_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a JSON array, exploded and gathered again in a stated order."""
    e = table(spark, sf_dir, "events")
    packed = e.groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("event_type"))).alias("items"))
    item = packed.select("user_id", F.explode(F.from_json("items", "array<struct<event_type:string>>")).alias("x"))
    return item.groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("x.event_type")).alias("kinds"))


@query("SELECT a.l_orderkey, a.l_linenumber AS left_line, b.l_linenumber AS right_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def pair_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs within a group whose size its kind bounds (an order's few lines); duplicates.shared_units is for others."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return l.alias("a").join(l.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber")).select("a.l_orderkey", F.col("a.l_linenumber").alias("left_line"), F.col("b.l_linenumber").alias("right_line"))


@query("SELECT a.l_orderkey, a.l_returnflag, a.l_linenumber AS left_line, b.l_linenumber AS right_line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem WHERE l_linestatus = 'O') a JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem WHERE l_linestatus = 'F') b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.k = b.k")
def kth_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_linestatus")
    pairs = kth_occurrence(l.where("l_linestatus = 'O'").drop("l_linestatus"), l.where("l_linestatus = 'F'").drop("l_linestatus"), "l_returnflag", ["l_orderkey"], "l_linenumber")
    return pairs.select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("left_line"), F.col("right_l_linenumber").alias("right_line"))


@query("SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM nation n WHERE length(n_name) >= 5 AND contains(lower(p_name), lower(n_name))) OR contains(p_type, p_brand)")
def containment_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text contains one of a few fixed terms; the terms' table has a fixed size."""
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation").where(F.length("n_name") >= 5)
    hit = p.join(F.broadcast(n), F.lower("p_name").contains(F.lower("n_name")), "left_semi").select("p_partkey")
    return hit.union(p.where(F.col("p_type").contains(F.col("p_brand"))).select("p_partkey")).distinct()


@query("SELECT l.l_orderkey, l.l_linenumber, CASE WHEN a.o_orderkey IS NOT NULL THEN 1 WHEN b.p_partkey IS NOT NULL THEN 2 ELSE 3 END AS strategy FROM lineitem l LEFT JOIN orders a ON l.l_orderkey = a.o_orderkey AND a.o_orderstatus = 'P' LEFT JOIN part b ON l.l_partkey = b.p_partkey AND b.p_size < 10")
def ladder_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first strategy of a ladder that finds a partner: staged joins on each strategy's own key."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("a"))
    b = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(2).alias("b"))
    return l.join(a, "l_orderkey", "left").join(b, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("a", "b", F.lit(3)).alias("strategy"))


@query("WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS rn, o_totalprice - lead(o_totalprice) OVER w AS margin FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) SELECT o_custkey, o_orderkey, CASE WHEN margin IS NULL OR margin >= 5000 THEN 'matched' ELSE 'unclear' END AS status FROM s WHERE rn = 1")
def argmax_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), (F.col("o_totalprice") - F.lead("o_totalprice").over(w)).alias("margin"))
    return s.where("rn = 1").select("o_custkey", "o_orderkey", F.when(F.col("margin").isNull() | (F.col("margin") >= 5000), "matched").otherwise("unclear").alias("status"))


_BOX = "SELECT l_orderkey AS page, l_linenumber AS id, l_quantity AS x0, l_quantity + 5 AS x1, l_tax * 100 AS y0, l_tax * 100 + 2 AS y1, l_returnflag FROM lineitem"


@query(f"WITH b AS ({_BOX}) SELECT page, id FROM b WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM b r WHERE r.l_returnflag = 'R' AND r.page = b.page AND r.x0 < b.x1 AND b.x0 < r.x1 AND r.y0 < b.y1 AND b.y0 < r.y1)")
def bbox_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that overlap no excluded region of their page; edges that touch do not overlap."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_tax") * 100).alias("y0"), (F.col("l_tax") * 100 + 2).alias("y1"), "l_returnflag")
    a, r = b.where("l_returnflag <> 'R'").alias("a"), b.where("l_returnflag = 'R'").alias("r")
    return a.join(r, F.expr("r.page = a.page and r.x0 < a.x1 and a.x0 < r.x1 and r.y0 < a.y1 and a.y0 < r.y1"), "left_anti").select("page", "id")


@query("SELECT a.event_id, b.event_id AS near_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def range_join_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval join on bins of the interval's width, so that a user with many events is many keys."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    bins = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    a = e.withColumn("bin", F.explode(F.array(bins, bins + 1))).alias("a")
    b = e.withColumn("bin", bins).alias("b")
    on = F.expr("a.user_id = b.user_id and a.bin = b.bin and a.event_type <> b.event_type and b.ts > a.ts and b.ts <= a.ts + interval 1 hour")
    return a.join(b, on).select("a.event_id", F.col("b.event_id").alias("near_id"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, offset = clamp_page(50, 100)
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(offset).limit(limit).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


@query("SELECT o_orderpriority, o_orderkey, rn FROM (SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn <= 10")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).alias("rn")).where("rn <= 10")


@query("SELECT l_suppkey, arg_max(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS l_orderkey, max(l_extendedprice) AS price FROM lineitem GROUP BY l_suppkey")
def argmax_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("l_orderkey"), F.max("l_extendedprice").alias("price"))


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_discount, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def keep_best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return first_per_key(l, ["l_partkey", "l_suppkey"], [F.desc("l_quantity"), F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_quantity", "l_discount")


@query("SELECT o_orderkey, arg_min(l_linenumber, (abs(l_extendedprice - o_totalprice / 4), l_linenumber)) AS l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def closest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderkey").agg(F.min_by("l_linenumber", F.struct(F.abs(F.col("l_extendedprice") - F.col("o_totalprice") / 4), "l_linenumber")).alias("l_linenumber"))


@query("SELECT user_id, coalesce(min(ts) FILTER (event_type = 'purchase'), min(ts)) AS first_ts FROM events GROUP BY user_id")
def earliest_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))), F.min("ts")).alias("first_ts"))


@query("SELECT l_orderkey AS k FROM lineitem UNION SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan: the three key columns become rows."""
    return table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_orderkey", "l_partkey", "l_suppkey")).alias("k")).distinct()


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(returned, "p_partkey", "left_anti")

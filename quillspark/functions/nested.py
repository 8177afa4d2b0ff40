"""Arrays, maps, ranges and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table


def overridden(base: Column, top: Column) -> Column:
    """Entries of two maps; those of `top` win. A null map has none."""
    none = F.create_map().cast("map<string,string>")
    base, top = F.coalesce(base, none), F.coalesce(top, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def covered(inner: Column, outer: Column) -> Column:
    """Whether each range of `inner` (structs s, e) lies within one of `outer`; no range at all is covered."""
    return F.forall(inner, lambda r: F.exists(outer, lambda o: (o["s"] <= r["s"]) & (r["e"] <= o["e"])))


def centre(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    return (x0 + x1) / 2, (y0 + y1) / 2


def manhattan(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])


@query("SELECT user_id, list(event_type ORDER BY ts, event_id) AS kinds FROM (SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL) GROUP BY user_id")
def array_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kinds of events in the order of their first; kinds are few, so they are gathered only once they are distinct."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]).alias("kinds"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + 2.5 AS cx, l_tax * 100 + 1 AS cy, abs(l_quantity + 2.5 - 25) + abs(l_tax * 100 + 1 - 4) AS distance FROM lineitem")
def bbox_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_tax") * 100
    cx, cy = centre(x, y, x + 5, y + 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cx.alias("cx"), cy.alias("cy"), manhattan((cx, cy), (F.lit(25.0), F.lit(4.0))).alias("distance"))


@query("WITH n AS (SELECT l_orderkey, coalesce(max(l_linenumber) FILTER (l_linestatus = 'O'), 0) AS pages FROM lineitem GROUP BY 1) SELECT l_orderkey, list(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE l_linenumber + pages END ORDER BY l_linestatus DESC, l_linenumber) AS pages FROM lineitem JOIN n USING (l_orderkey) GROUP BY l_orderkey")
def concat_with_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of two parts of a document as one: those of the second are moved behind the first's."""
    of = lambda status: F.sort_array(F.collect_list(F.when(F.col("l_linestatus") == status, F.col("l_linenumber"))))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of("O").alias("a"), of("F").alias("b"))
    last = F.coalesce(F.array_max("a"), F.lit(0))
    return g.select("l_orderkey", F.concat("a", F.transform("b", lambda p: p + last)).alias("pages"))


@query("SELECT event_id, CAST(coalesce(k, '') AS VARCHAR) AS shown, CASE WHEN k IS NULL THEN 0 ELSE 1 END AS n FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a JSON map that may be shown: keys that do not begin with an underscore, values that are there."""
    m = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: ~k.startswith("_") & v.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("k")), F.lit("")).alias("shown"), F.size(F.map_keys(m)).alias("n"))


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS quality, lang, CASE WHEN l.doc_id IS NULL THEN 2 ELSE 3 END AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def map_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang").alias("d"), table(spark, sf_dir, "labels").alias("l")
    base = F.create_map(F.lit("quality"), F.lit("unknown"), F.lit("lang"), F.col("lang"))
    top = F.when(F.col("l.doc_id").isNotNull(), F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")))
    m = d.join(l, F.col("d.doc_id") == F.col("l.doc_id"), "left").select("d.doc_id", overridden(base, top).alias("m"))
    return m.select("doc_id", F.try_element_at("m", F.lit("quality")).alias("quality"), F.try_element_at("m", F.lit("lang")).alias("lang"), F.size(F.map_keys("m")).alias("n"))


_RANGES = "(SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + l_linenumber * CASE l_returnflag WHEN 'R' THEN 1 ELSE 5 END AS e, l_returnflag = 'R' AS inner_ FROM lineitem)"


@query(f"SELECT o.l_orderkey, NOT EXISTS (SELECT 1 FROM {_RANGES} r WHERE r.l_orderkey = o.l_orderkey AND r.inner_ AND NOT EXISTS (SELECT 1 FROM {_RANGES} x WHERE x.l_orderkey = r.l_orderkey AND NOT x.inner_ AND x.s <= r.s AND r.e <= x.e)) AS covered FROM (SELECT DISTINCT l_orderkey FROM lineitem) o")
def ranges_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("l_returnflag") == "R"
    s = F.col("l_quantity").cast("int")
    r = F.struct(s.alias("s"), (s + F.col("l_linenumber") * F.when(inside, 1).otherwise(5)).alias("e"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(inside, r)).alias("inner"), F.collect_list(F.when(~inside, r)).alias("outer"))
    return g.select("l_orderkey", covered(F.col("inner"), F.col("outer")).alias("covered"))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f', round_even(l_quantity / 8, 2)) AS price FROM lineitem")
def decimal_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two decimals, ties to the even digit."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.2f", F.bround(F.col("l_quantity") / 8, 2)).alias("price"))


#: Names of one kind of thing, and the name it goes by.
SYNONYMS = {"click": "interaction", "view": "interaction", "purchase": "order"}


@query("SELECT event_id, coalesce(canonical, event_type) AS kind FROM events LEFT JOIN (VALUES ('click', 'interaction'), ('view', 'interaction'), ('purchase', 'order')) AS t(name, canonical) ON lower(trim(event_type)) = name")
def dict_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by a dictionary of fixed size; a name that it does not hold stays."""
    named = spark.createDataFrame(list(SYNONYMS.items()), "name string, canonical string")
    e = table(spark, sf_dir, "events")
    return e.join(F.broadcast(named), F.lower(F.trim("event_type")) == F.col("name"), "left").select("event_id", F.coalesce("canonical", "event_type").alias("kind"))

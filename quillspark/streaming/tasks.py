"""What a queue of review tasks answers at a moment: order, progress, cancellation, cached results, slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table

#: Devices, and how long a progress report or a cached result holds.
SLOTS, HOLDS = 4, "1 hour"


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN coalesce(bool_and(o_orderstatus = 'F') OVER w, true) THEN 'ready' ELSE 'waiting' END AS state FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def task_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a project run one after the other: the first that is not done is ready, later ones wait."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    free = F.coalesce(F.bool_and(F.col("o_orderstatus") == "F").over(w), F.lit(True))
    state = F.when(F.col("o_orderstatus") == "F", "done").when(free, "ready").otherwise("waiting")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", state.alias("state"))


@query("WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY 1) SELECT user_id, state, ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS live FROM l")
def live_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last report of each task, and whether it still holds."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))  # a single row
    return last.join(F.broadcast(now), F.lit(True)).select("user_id", "state", (F.col("ts") >= F.col("now") - F.expr(f"interval {HOLDS}")).alias("live"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'error' AND c.ts < e.ts)")
def uncancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of tasks that were not cancelled before them; the first cancellation of a task decides."""
    e = table(spark, sf_dir, "events")
    c = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("since"))
    return e.join(c, "user_id", "left").where("since is null or since >= ts").select("event_id")


@query("WITH f AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) SELECT event_id, coalesce(ts - before <= INTERVAL 1 HOUR, false) AS hit FROM f")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that find what the read before them of the same key has left, if that still holds; each read renews it."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hit = F.col("ts") <= F.lag("ts").over(w) + F.expr(f"interval {HOLDS}")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(hit, F.lit(False)).alias("hit"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) % 4 AS INTEGER) AS slot FROM lineitem")
def device_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document dealt to devices in turn, so that none has two more than another."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((F.row_number().over(w) - 1) % SLOTS).alias("slot"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 3 END >= 1 AS reached FROM orders")
def stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a project's parsing has reached the stage that a check needs."""
    stage = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(3)
    return table(spark, sf_dir, "orders").select("o_orderkey", (stage >= 1).alias("reached"))

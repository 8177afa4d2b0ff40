"""Incremental ingest: idempotent batches, de-duplication, progress and event windows on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.registry import kept_folder, query, table


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder, a bounded number each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def deduplicated(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of each key; a key's state goes once the watermark has passed it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums of each kind in tumbling windows; the same plan for a stream and for a table."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def upsert(batches: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch under its number, so that a batch that runs again replaces what it wrote before."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ev_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"), late=None)


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) - count(*) FILTER (event_type = 'purchase') AS pending, max(ts) AS last_ts FROM events GROUP BY user_id")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("event_type") == "purchase")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), done.alias("completed"), (F.count("*") - done).alias("pending"), F.max("ts").alias("last_ts"))


@query("SELECT window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS window_start, event_type FROM events, (VALUES (0), (1)) AS t(i)) GROUP BY ALL")
def ev_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that begin each half hour."""
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = "1 hour") -> DataFrame:
    """A user's sessions: events with less than `gap` between them; the same plan for a stream and for a table."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return g.select("user_id", F.col("w.start").alias("first_ts"), "last_ts", "n")


@query("WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM i GROUP BY user_id, k")
def ev_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), late=None)


@query("SELECT event_id, min(user_id) AS user_id, min(event_type) AS event_type FROM events GROUP BY event_id")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the stream: new files, repeats dropped, batches written under their numbers and read again."""
    folder = kept_folder(spark, "events")
    e = table(spark, sf_dir, "events")
    source = stream(spark, f"{sf_dir}/events*.parquet", e.schema)
    source = deduplicated(source.withColumn("ts", F.col("ts").cast("timestamp")), late="3650 days")
    upsert(source, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")

from pyspark.sql import functions as F

from quillspark.streaming.ingest import deduplicated, stream, upsert, windowed

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_repeats_go_once(spark, tmp_path):
    e = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):
        e.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = stream(spark, str(tmp_path / "in/*"), e.schema)
    upsert(deduplicated(source, late="3650 days"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == e.count()


def test_windows_of_stream_and_table_agree(spark, tmp_path):
    e = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = windowed(stream(spark, str(tmp_path / "in"), e.schema)).writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((r.window_start, r.event_type, r.n, r.total) for r in df.collect())
    assert rows(spark.table("hourly")) == rows(windowed(e, late=None))

"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import copies, cut, md5_long, n_words, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken so often at most.
MOST = 3
#: Tilts of the sources' schedules in code-point order, repeating: a source's weight at time t of the training
#: (0 to 1) is its weight times 1 + tilt (2 t - 1), so it falls, stays or rises and integrates to the weight.
TILTS = (-0.5, 0.0, 0.5)
#: Rows that a bucket of a source's running sum is meant to hold, the bits of a hash that name a bucket at most, and those
#: of them that name a bucket within its block: a source's blocks are put in order in one task, as are a block's buckets.
BUCKET_ROWS, BUCKET_BITS, BLOCK_BITS = 400, 28, 12


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, tilts=TILTS) -> DataFrame:
    """(source, source_size) to source, source_size, rank, weight, tilt, target.

    Targets share all words by weight; one that would exceed `most` times its source's size stops there and
    its excess is reshared by weight, until none is above. Each round is an aggregation of the source
    table, and a round that stops no further source is the last.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row for each source
    pick = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col("rank") % len(xs) + 1)
    s = sizes.withColumn("rank", rank).withColumns({"weight": pick(weights, "double"), "tilt": pick(tilts, "double")}).withColumn("cap", F.col("source_size") * float(most))
    s = cut(s)
    level, stopped = 0.0, -1
    while True:
        is_full = F.col("cap") < F.col("weight") * level if stopped >= 0 else F.lit(False)
        n, whole, full, free = s.agg(F.sum(is_full.cast("long")), F.sum("source_size"), F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))).first()
        if n is None or n == stopped or not free:
            break
        level, stopped = (whole - full) / free, n
    return s.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(float(level)))).drop("cap")


def _schedule(t: str) -> str:
    """SQL: the share of a source's words that its schedule gives until time t: the integral of 1 + tilt (2 t - 1)."""
    return f"({t} * (1 + tilt * ({t} - 1)))"


def _time(u: str) -> str:
    """SQL: the time at which a schedule has given the share u: the inverse of its integral."""
    return f"if(tilt = 0, {u}, (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * {u})) / (2 * tilt))"


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, tilts=TILTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, source, ...) to one row per input row, range-sorted by position: doc_id, size,
    source_size, target, taken, source, positions, position.

    Within a source the documents stand end to end in the order of a hash of doc_id and size, and that line is
    repeated up to `most` times. The words before a document are a share of the source's demand, round(target) words;
    the integral of the source's weight schedule, inverted at that share, is the document's position in the training
    (0 to 1), and the same at its end. It is taken while the training lasts: from its position to its end or to 1, the
    schedule gives so many words of it. So a source's taken words meet its target, the document on which they end
    gives its leading words only, and none is taken over `most` times. positions lists a document's beginnings,
    ascending; the rows are sorted by the first (position; null for those not taken, which come last).

    Running sums go by hash buckets within a source, and rows meet targets by bucket, so a hot source is spread over
    many tasks. Rows that repeat doc_id, source and size are counted before the shuffle. Null texts have size 0, null
    sources are one source, the last; null doc_ids are kept. Other columns are ignored; empty gives empty.
    """
    light = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size"))
    light = cut(light.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("h", md5_long(key)))
    per = cut(light.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.count("*").alias("rows")))
    aims = cut(targets(per.select("source", "source_size"), weights, most, tilts))
    bits = min(BUCKET_BITS, max(0, math.ceil(math.log2(max(1, (per.agg(F.max("rows")).first()[0] or 0) / bucket_rows)))))
    light = light.withColumn("bucket", F.shiftright("h", 60 - bits))
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    base = cut(light.groupBy("source", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("b")).withColumn("block", F.shiftright("bucket", BLOCK_BITS)))
    block = base.groupBy("source", "block").agg(F.sum("b").alias("b")).select("source", "block", F.coalesce(F.sum("b").over(before("source").orderBy("block")), F.lit(0)).alias("to_block"))
    base = base.withColumn("base", F.coalesce(F.sum("b").over(before("source", "block").orderBy("bucket")), F.lit(0)))
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    base = base.alias("b").join(block.alias("k"), same(base, block, "source", "block")).select("b.source", "b.bucket", (F.col("base") + F.col("to_block")).alias("base"))
    line = light.withColumn("c", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before("source", "bucket").orderBy("h", "doc_id", "size")), F.lit(0)))
    base = base.alias("b").join(aims.alias("a"), same(base, aims, "source")).select("b.*", "a.source_size", "a.target", "a.tilt")
    line = line.alias("l").join(base.alias("b"), same(line, base, "source", "bucket")).select("l.*", "b.base", "b.source_size", "b.target", "b.tilt")
    out = copies(line, "n", "copy").selectExpr("doc_id", "size", "source_size", "target", "source", "tilt", "base + c + copy * size as at", "floor(target + 0.5) as demand")
    begins = f"filter(transform(sequence(0, {most - 1}), p -> p * source_size + at), x -> x < demand and size > 0)"
    out = out.withColumn("times", F.expr(f"transform({begins}, x -> named_struct('start', {_time('(x / demand)')}, 'stop', {_time('(least(x + size, demand) / demand)')}))"))
    given = f"cast(floor(demand * ({_schedule('x.stop')} - {_schedule('x.start')}) + 0.5) as bigint)"
    out = out.selectExpr("doc_id", "size", "source_size", "target", f"aggregate(times, 0L, (a, x) -> a + {given}) as taken", "source", "transform(times, x -> x.start) as positions", "get(times, 0).start as position")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, in training order, with the columns they had, whatever their names: a row for each time
    that a document is taken; the one on which a source's words end has its leading words only (and n_chars, if there is
    one, of those). Documents that are not taken, among them those without words, are not there."""
    key = ["doc_id", "source", "size"]
    plan = mix(docs, **options).where("taken > 0").withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("taken"), "position"))).alias("m")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # columns of docs cannot clash with those made here
    sized = docs.select(whole, "doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = sized.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row.text")))).alias("d")
    rows = sized.join(plan, [F.col(f"d.{x}").eqNullSafe(F.col(f"m.{x}")) for x in (*key, "copy")]).select("d.row", "d.doc_id", "d.size", F.posexplode("m.positions").alias("time", "at"), "m.taken")
    left = F.least(F.col("size"), F.col("taken") - F.col("time") * F.col("size")).cast("int")
    lead = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, left), "")
    rows = rows.withColumn("text", F.when(left >= F.col("size"), F.col("row.text")).otherwise(lead))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(left >= F.col("size"), F.col("row.n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    out = rows.repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id")
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), F.size("positions").alias("times")]
    return mix(table(spark, sf_dir, "documents")).select(*columns)


#: The same rows in SQL.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w,
         0.5::DOUBLE * ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 - 1) AS tilt
  FROM d GROUP BY source),
f(i, level, stopped) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(w) FROM s), 0::BIGINT
  UNION ALL
  SELECT i + 1,
         (SELECT (sum(source_size) - sum(CASE WHEN 3 * source_size < w * level THEN 3.0::DOUBLE * source_size ELSE 0 END))
                 / sum(CASE WHEN 3 * source_size < w * level THEN 0 ELSE w END) FROM s),
         (SELECT count(*) FROM s WHERE 3 * source_size < w * level)
  FROM f WHERE i < 40),
t AS (
  SELECT source, source_size, tilt, least(3.0::DOUBLE * source_size, w * (SELECT arg_max(level, i) FROM f)) AS target FROM s),
l AS (
  SELECT d.doc_id, d.source, size, source_size, target, tilt, floor(target + 0.5) AS demand,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || size), 1, 15) AS BIGINT), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT doc_id, size, source_size, target, tilt, demand,
         list_transform(list_filter([pos, source_size + pos, 2 * source_size + pos], lambda x: x < demand AND size > 0),
                        lambda x: {'a': x::DOUBLE / demand, 'b': least(x + size, demand)::DOUBLE / demand}) AS shares FROM l),
v AS (
  SELECT *, CASE WHEN tilt = 0 THEN shares ELSE list_transform(shares, lambda x: {
    'a': (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x.a)) / (2 * tilt),
    'b': (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x.b)) / (2 * tilt)}) END AS times FROM u)
SELECT doc_id, size, source_size, target,
       CAST(coalesce(list_sum(list_transform(times, lambda x: floor(demand * (x.b * (1 + tilt * (x.b - 1)) - x.a * (1 + tilt * (x.a - 1))) + 0.5))), 0) AS BIGINT) AS taken,
       round(times[1].a, 9) AS position, CAST(len(times) AS INTEGER) AS times
FROM v
"""

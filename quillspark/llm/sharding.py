"""Sharding by sampled splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import copies, cut, md5_long, table

SHARDS = 24
#: Ranges that a shard is meant to consist of, keys sampled for each range, and ranges at most in each of two levels.
FINE, SAMPLE, FAN = 128, 32, 128
#: A shard ends at the start of a group of equal texts if one is as near as this share of a shard.
WHOLE = 0.01
#: Low bits of the key, from doc_id: they divide a group of equal texts.
DOC_BITS = 20
#: Rows that are numbered in one task, about.
SLOT_ROWS = 2_000
#: Rows of a range that the ranges of other operators are meant to hold.
RANGE_ROWS = 50_000


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at or below key; two levels, so that a row is compared to 2 FAN at most."""
    if not splitters:
        return F.lit(0)
    parts = [splitters[i : i + FAN] for i in range(0, len(splitters), FAN)]
    below = lambda cells: F.size(F.filter(cells, lambda s: s <= key))
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    if len(parts) == 1:
        return below(array(parts[0]))
    coarse = F.greatest(below(array([p[0] for p in parts])), F.lit(1))
    return (coarse - 1) * FAN + below(F.element_at(F.array(*[array(p) for p in parts]), coarse))


def _sample(rows: DataFrame, rate: float) -> list[tuple[int, float]]:
    """Sampled keys in order with the size that each stands for. A row is drawn with probability min(1, rate x weight), the
    same on every run. The caller bounds rate x the total weight, hence the driver's list."""
    draw = (F.xxhash64("key", "doc_id", F.lit("splitter")) % F.lit(2**31) + F.lit(2**31)) / F.lit(float(2**32))
    drawn = rows.where(draw < F.col("weight") * F.lit(rate)).select("key", F.greatest(F.col("weight").cast("double"), F.lit(1 / rate)).alias("mass"))
    return sorted((r.key, r.mass) for r in drawn.collect())


def _quantiles(sample: list[tuple[int, float]], parts: int) -> list[int]:
    """Keys that cut the sampled sizes in about `parts` equal parts, each cut at the nearest key. In a group of equal texts the
    first cut moves to the group's first key; a group that holds more cuts is large, and they divide it."""
    step, since, found = sum(mass for _, mass in sample) / max(1, parts), 0.0, {}
    for key, mass in sample:
        if since and since + mass / 2 > step:
            group = found.setdefault(key >> DOC_BITS, [])
            group.append(key if group else key >> DOC_BITS << DOC_BITS)
            since = 0.0
        since += mass
    return sorted(key for group in found.values() for key in group)


def _boundaries(edges: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """edges: (size before, splitter). The splitters that end shards: for each even share the nearest edge, one at a group's
    start if it is as near as WHOLE of a shard; a shard without an edge of its own is empty."""
    out, at = [], 0
    for i in range(1, shards):
        aim = i * total / shards
        while at < len(edges) and edges[at][0] < aim:
            at += 1
        near, best, whole = [], None, None
        for step, start in ((-1, at - 1), (1, at)):
            j = start
            while 0 <= j < len(edges) and abs(edges[j][0] - aim) <= max(WHOLE * total / shards, abs(edges[start][0] - aim)):
                near.append(edges[j])
                j += step
        for edge in near:
            off = abs(edge[0] - aim)
            if best is None or off < best[0]:
                best = (off, edge[1])
            if edge[1] % (1 << DOC_BITS) == 0 and off <= WHOLE * total / shards and (whole is None or off < whole[0]):
                whole = (off, edge[1])
        if chosen := whole or best:
            out.append(max(chosen[1], out[-1]) if out else chosen[1])
    return out


def splitters(light: DataFrame, total: int, shards: int) -> list[int]:
    """(key, doc_id, weight) to the first keys of all shards but the first.

    A size-weighted sample of SAMPLE keys a range gives FINE ranges a shard; all rows are range-partitioned by its
    quantiles and weighed. A range of over twice its share is subdivided at quantiles of a finer sample of its own, until
    none is left that holds more than one key (or FAN x FAN ranges are reached). Shards end where ranges do."""
    parts = min(shards * FINE, FAN * FAN // 2)
    found = _quantiles(_sample(light, SAMPLE * parts / total), parts)
    fair = total / parts
    for again in (True, True, True, True, False):
        ranged = light.withColumn("range", _range_of(F.col("key"), found))
        held = {r.range: r for r in ranged.groupBy("range").agg(F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        over = {r: x for r, x in held.items() if x.weight > 2 * fair and x.low < x.high}
        if not again or not over or len(found) + sum(int(x.weight / fair) for x in over.values()) >= FAN * FAN:
            break
        finer = _sample(ranged.where(F.col("range").isin(list(over))), SAMPLE / fair)
        more = set()
        for x in over.values():
            more.update(_quantiles([(k, m) for k, m in finer if x.low <= k <= x.high], 2 * int(x.weight / fair)))
        if more <= set(found):
            break
        found = sorted(more.union(found))
    edges, before = [], 0
    for i, key in enumerate(found):
        before += held[i].weight if i in held else 0
        edges.append((before, key))
    return _boundaries(edges, total, shards)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, text, ...) to one row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: the shards' sizes are near equal, where a row's size is its text's UTF-8 bytes (null: none)
    plus 8. Records are ordered by a uniform key (40 bits of the text's MD5, 20 of the doc_id's), so equal
    texts stand together, and shards are ranges of that key (see splitters): they differ from an equal share by half
    a range (a 128th of a shard) or half a record, whichever is larger, at either end. A group of equal texts is divided
    only where a shard ends in it and no other end is near.

    Rows are numbered within a shard by hash buckets and the buckets' sums. Rows that repeat doc_id and text are counted
    before the shuffle and dealt out one after the other. Null texts have crc32 0; null doc_ids are kept.
    grown_shard is null under this law. Other columns are ignored; empty gives empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        (F.shiftleft(md5_long(text, 10), DOC_BITS) + md5_long(F.col("doc_id").cast("string"), DOC_BITS // 4)).alias("key"),
    )
    light = cut(light.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n")).withColumn("weight", F.col("size") * F.col("n")))
    rows, total = light.agg(F.count("*"), F.sum("weight")).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    buckets = -(-rows // (shards * SLOT_ROWS))
    placed = light.withColumn("shard", _range_of(F.col("key"), splitters(light, total, shards)).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("key", "doc_id"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("b")).select("shard", "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"))
    run = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("r", F.coalesce(F.sum("n").over(run), F.lit(0))).join(base, ["shard", "bucket"])
    return copies(placed, "n", "copy").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("r") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

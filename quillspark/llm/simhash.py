"""SimHash near-dedup by deletion-variant signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, copies, cut, table, words
from quillspark.operators.graph import components, spread_join

#: Counters of two bits share a long, 32 bits each: no text has 2^32 shingles.
LANES = 32


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, th, fp long, copies long), th a hash of the text: the 64-bit SimHash of the 3-word shingles of each
    whole lower-cased text, and how many equal rows it stands for.

    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). One or two words make one
    shingle; no words, an empty or a null text give fingerprint 0. Rows that repeat a doc_id with another
    text keep a fingerprint of their own.
    """
    w = docs.select("doc_id", F.xxhash64(F.col("text")).alias("th"), words(ascii_lower(F.col("text"))).alias("w"))
    pos = w.selectExpr("doc_id", "th", "w", "explode(sequence(0, greatest(size(w) - 3, 0))) as p")
    # the array stays in its row: positions are read from it inside the generated loop
    h = pos.selectExpr("doc_id", "th", "p", "case when size(w) >= 3 then xxhash64(concat(w[p], ' ', w[p + 1], ' ', w[p + 2])) when size(w) > 0 then xxhash64(concat_ws(' ', w)) end as h")
    sums = [F.expr(f"sum((shiftrightunsigned(h, {i}) & 1) | (shiftrightunsigned(h, {i + LANES}) & 1L) << 32)").alias(f"s{i}") for i in range(LANES)]
    per = h.groupBy("doc_id", "th").agg(F.count("h").alias("n"), F.sum(F.expr("if(p = 0, 1L, 0L)")).alias("copies"), *sums)
    low = [f"if(2 * (s{i} & 4294967295L) > n, {1 << i}L, 0L)" for i in range(LANES)]
    high = [f"shiftleft(if(2 * shiftrightunsigned(s{i}, 32) > n, 1L, 0L), {i + LANES})" for i in range(LANES)]
    fp = reduce(lambda a, b: f"{a} | {b}", low + high)
    return per.selectExpr("doc_id", "th", f"coalesce({fp}, 0L) as fp", "copies")


#: Crowded keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def links(fps: DataFrame, crowd: int = 4096) -> DataFrame:
    """fps: distinct (fp long). All pairs (a, b) of fingerprints that differ in three bits or fewer are
    connected by the links returned; each link holds.

    A fingerprint is cut into two halves, so one half of a linked pair differs in at most one bit. Indexed
    are each half as it is and with each of its 32 bits wiped; the side with the wiped bit 0 meets the side
    with it 1, so a pair meets where it differs and nowhere else. The equality join verifies all 64 bits.

    In a key that over `crowd` fingerprints may share (told by the counts of the halves that lead to it) no pairs are
    formed. There the other half is indexed in turn, with two of its bits wiped, or three where the first half is
    whole: 496 or 4,960 rows a fingerprint and key. All that share both keys differ in three bits at most, so linking each
    to the smallest loses nothing and is linear in the fingerprints, whatever their number.
    """
    halves = fps.selectExpr("explode(array(0, 1)) as half", "fp").selectExpr("half", "fp & if(half = 0, 4294967295L, -4294967296L) as v")
    full = cut(halves.groupBy("half", "v").count().where(F.col("count") * 2 > crowd).select("half", "v"))
    keys = fps.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(65)))).selectExpr(
        "c",
        "fp & if(c < 32 or c = 64, 4294967295L, -4294967296L) & if(c < 64, ~shiftleft(1L, c), -1L) as v",
        "fp",
        "if(c < 64, cast(shiftrightunsigned(fp, c) & 1 as int), 2) as side",
    )
    n_full = full.count()
    crowded = None
    if n_full:
        # the keys that a full half leads to: itself, and with each of its bits wiped
        led = full.selectExpr("half", "v", "explode(sequence(0, 32)) as i").selectExpr("if(i = 32, 64 + half, 32 * half + i) as c", "if(i = 32, v, v & ~shiftleft(1L, 32 * half + i)) as v").distinct()
        led = F.broadcast(led) if n_full * 33 <= BROADCAST_KEYS else led
        crowded, keys = keys.join(led, ["c", "v"]), keys.join(led, ["c", "v"], "left_anti")
    zero = keys.where("side <> 1").select("c", "v", F.col("fp").alias("a"))
    one = keys.where("side <> 0").select("c", "v", F.col("fp").alias("b"))
    met = zero.join(one, ["c", "v"]).where("(c < 64 or a < b) and bit_count(a ^ b) <= 3").select("a", "b")
    if crowded is not None:
        base = "if(c < 32 or c = 64, 32, 0)"  # the first bit of the other half
        two = crowded.selectExpr("c", "fp", f"explode(sequence({base} + 1, {base} + 31)) as i").selectExpr("c", "fp", "i", f"explode(sequence({base}, i - 1)) as j")
        three = two.where("c >= 64 and j > if(c = 64, 32, 0)").selectExpr("c", "fp", "i", "j", f"explode(sequence({base}, j - 1)) as k")
        wipe = lambda *bits: " | ".join(f"shiftleft(1L, {b})" for b in bits)
        wiped = two.where("c < 64").selectExpr("fp", "cast(c * 262144 + i * 4096 + j * 64 as int) as w", f"fp & ~({wipe('c', 'i', 'j')}) as v")
        wiped = wiped.union(three.selectExpr("fp", "cast(c * 262144 + i * 4096 + j * 64 + k as int) as w", f"fp & ~({wipe('i', 'j', 'k')}) as v"))
        hub = wiped.groupBy("w", "v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        met = met.union(wiped.join(hub, ["w", "v"]).where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return met.distinct()


def _grouped(docs: DataFrame, crowd: int) -> DataFrame:
    """fingerprints() of docs with their components: doc_id, th, fp, copies, root, component_id. A fingerprint of many
    documents and a component of many fingerprints stay spread over tasks."""
    fp = cut(fingerprints(docs.select("doc_id", "text")))
    nodes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")))
    roots = components(links(nodes.select("fp"), crowd)).toDF("fp", "root")
    linked = cut(nodes.join(roots, "fp"))
    sizes = cut(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("prints")))
    named = spread_join(linked.select("fp", "root"), sizes, "root", "prints")
    ids = nodes.join(named, "fp", "left").selectExpr("fp", "docs", "coalesce(root, fp) as root", "coalesce(component_id, rep) as component_id")
    return spread_join(fp, cut(ids), "fp", "docs")


def near_duplicates(docs: DataFrame, crowd: int = 4096) -> DataFrame:
    """(doc_id, text, ...) to one row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Texts whose fingerprints differ in three bits or fewer are linked; component_id is the smallest doc_id
    that links reach. Equal fingerprints are one node, so a group of copies costs one node however many
    it has. Null and blank texts share fingerprint 0. Null doc_ids keep their rows; a component of null
    doc_ids only has a null component_id. Other columns are ignored; an empty table gives an empty result.
    """
    return copies(_grouped(docs, crowd), "copies", "copy").selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


def deduplicated(docs: DataFrame, crowd: int = 4096) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (nulls last; of its texts the one with the
    smallest hash), and all their columns."""
    first = _grouped(docs, crowd).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x"), F.max("copies").alias("copies"))
    first = cut(first.select("x.doc_id", "x.th", "copies"))
    d, f = docs.alias("d"), first.alias("f")
    kept = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.th")), "left_semi")
    return kept if first.where("copies > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

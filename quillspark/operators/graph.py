"""Connected components of links between documents, or of anything else that can be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.duplicates import _CLASSES, _UNITS, duplicate_classes, line_units
from quillspark.plans.registry import kept, query, table


def spread_join(rows: DataFrame, ids: DataFrame, key: str, size: str, most: int = 512, total: int | None = None) -> DataFrame:
    """The inner join of rows with ids by key (not null in ids), of which ids has one row each; its column `size` tells how
    many rows hold that key and does not come along. The keys that hold a `most`-th of all rows or more, `most` of
    them at most, are broadcast, so their rows stay spread; all others are shuffled. `total` is the number of all rows
    or more, if that is known."""
    total = (ids.agg(F.sum(size)).first()[0] or 0) if total is None else total
    is_hot = F.col(size) * most >= F.lit(total)
    hot = F.broadcast(ids.where(is_hot).drop(size))
    rest = rows.join(hot.select(key), key, "left_anti").join(ids.where(~is_hot).drop(size), key)
    return rows.join(hot, key).unionByName(rest)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) of one ordered type, any direction, repeats and loops allowed, to (node, component): for each node with a
    link to another the smallest node that links reach.

    In each round every node points its neighbourhood at its smallest member, larger neighbours first, then smaller
    ones; long chains halve. A hub's smallest neighbour is aggregated before the shuffle, and its links meet that by a
    broadcast (see spread_join), so no task gets them all. Rounds end when no link changes, told by the links' count and
    the sum of their hashes; each is written to the shared folder. Links with a null end are ignored; an empty table
    gives an empty result.
    """
    e = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = state()
    for _ in range(most_rounds):
        around = e.union(e.select("v", "u"))
        low = around.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"), "n").where("n > 0")
        far = kept(spread_join(e.select(F.col("v").alias("c"), F.col("u").alias("w")), low, "c", "n", total=now[0]).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct())
        low = far.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        new = spread_join(far, low, "u", "n", total=now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, before = kept(new.union(low.select("u", "m")).distinct()), now
        now = state()
        if now == before:
            own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def clusters(units: DataFrame) -> DataFrame:
    """(source, doc_id, h) to (doc_id, component): documents of a source that share a unit are one cluster, as are those that
    chains of such documents link. A unit that k documents hold makes k links, not k squared."""
    first = units.groupBy("source", "h").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").alias("f")
    links = units.alias("u").join(first, F.col("u.source").eqNullSafe(F.col("f.source")) & (F.col("u.h") == F.col("f.h"))).select(F.col("u.doc_id").alias("a"), "b")
    docs = units.select("doc_id").distinct()
    return docs.join(components(links), F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


_CLUSTERS = "e0 AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY source, h) AS b FROM u), e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b), cc(id, label) USING KEY (id) AS (SELECT DISTINCT doc_id, doc_id FROM u UNION SELECT e.b, min(cc.label) FROM cc JOIN e ON cc.id = e.a JOIN recurring.cc r ON r.id = e.b WHERE cc.label < r.label GROUP BY e.b)"


@query(f"WITH RECURSIVE {_UNITS}, {_CLUSTERS} SELECT id AS doc_id, label AS component FROM cc")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(line_units(table(spark, sf_dir, "documents")))


@query(f"WITH RECURSIVE {_UNITS}, {_CLASSES}, {_CLUSTERS}, s AS (SELECT source, h FROM u GROUP BY ALL HAVING count(*) > 1), m AS (SELECT label, count(*) AS lines FROM (SELECT DISTINCT label, h FROM u JOIN cc ON u.doc_id = id WHERE EXISTS (SELECT 1 FROM s WHERE s.h = u.h AND s.source IS NOT DISTINCT FROM u.source)) GROUP BY 1) SELECT cc.label AS component, count(*) AS documents, any_value(lines) AS lines, CASE WHEN bool_or(k.doc_id <> class_id) THEN 'exact' ELSE 'similar' END AS mode, CASE WHEN bool_or(k.doc_id <> class_id) THEN 4 ELSE 1 END AS rank FROM cc JOIN k ON id = k.doc_id JOIN m ON m.label = cc.label GROUP BY 1 HAVING count(*) > 1")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of two documents and more: their documents, the shared lines, exact if any two members are, and the rank by
    which stronger clusters come first."""
    units = kept(line_units(table(spark, sf_dir, "documents")))
    of = kept(clusters(units))
    shared = units.groupBy("source", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")
    lines = shared.join(of, "doc_id").groupBy("component").agg(F.countDistinct("h").alias("lines"))
    one = duplicate_classes(units).join(of, "doc_id").groupBy("component").agg(F.count("*").alias("documents"), F.bool_or(F.col("doc_id") != F.col("class_id")).alias("exact")).where("documents > 1")
    mode = F.when(F.col("exact"), "exact").otherwise("similar")
    return one.join(lines, "component").select("component", "documents", "lines", mode.alias("mode"), F.when(F.col("exact"), 4).otherwise(1).alias("rank"))

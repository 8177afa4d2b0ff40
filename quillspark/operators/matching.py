"""Set-similarity joins without all pairs of a group, greedy one-to-one matching, block-wise vector search."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions.text import bigrams
from quillspark.functions.values import cosine_blocks
from quillspark.plans.registry import kept, query, table


def same(left: str, right: str, *names: str) -> Column:
    """Equality of columns of two aliases in which nulls are equal."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def classes(sets: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, s array) to group, key, class_id: rows of a group whose sets are equal share the smallest key."""
    digest = F.sha2(F.array_join(F.sort_array("s"), "\x01"), 256)
    rows = sets.select(group, key, digest.alias("_d"))
    first = rows.groupBy(group, "_d").agg(F.min(key).alias("class_id"))
    return rows.alias("a").join(first.alias("b"), same("a", "b", group, "_d")).select(f"a.{group}", f"a.{key}", "class_id")


def similar_sets(sets: DataFrame, group: str, key: str, least: float, enough: int | None = None) -> DataFrame:
    """(group, key, s array<string> of different values) to group, l, r (l < r), shared, n_l, n_r: all pairs within a group
    whose Jaccard similarity is `least` or more (of a Dice coefficient d it is d / (2 - d)).

    Exact: values are ordered from the rarest to the most frequent of the group; two sets that are alike share a value
    among the first n - ceil(least n) + 1 of each, and their sizes differ by the factor `least` at most. So a value
    that many sets share makes candidates only of sets that hold almost nothing rarer, and no value is left out.
    With `enough`, pairs that share so many values are results too, whatever their similarity. A pair needs the fewer of
    the two counts, and a shared value makes candidates only if behind it, in both sets, enough are left to reach that.
    Give each class of equal sets once (see classes()). Empty and null sets are similar to nothing; null keys pair with
    nothing; a null group is a group.
    """
    e = sets.where("size(s) > 0").select(group, key, F.size("s").alias("n"), F.explode("s").alias("h"))
    often = e.groupBy(group, "h").agg(F.count("*").alias("f")).where("f > 1")
    rare = Window.partitionBy(group, key).orderBy(F.col("f").asc_nulls_first(), "h")
    e = e.alias("e").join(often.alias("o"), same("e", "o", group, "h"), "left").select("e.*", "f").withColumn("i", F.row_number().over(rare))
    need = lambda x: x if enough is None else F.least(x, F.lit(enough))
    head = kept(e.where((F.col("i") <= F.col("n") - need(F.ceil(F.col("n") * F.lit(least) - 1e-9)) + 1) & F.col("f").isNotNull()).select(group, key, "n", "h", "i"))
    a, b = head.alias("a"), head.alias("b")
    fits = F.least("a.n", "b.n") >= F.lit(least - 1e-9) * F.greatest("a.n", "b.n")
    if enough is not None:
        both = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(least / (1 + least)) - 1e-9)
        fits = (fits | (F.least("a.n", "b.n") >= enough)) & (F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) + 1 >= need(both))
    met = a.join(b, same("a", "b", group, "h") & (F.col(f"a.{key}") < F.col(f"b.{key}")) & fits).select(f"a.{group}", F.col(f"a.{key}").alias("l"), F.col(f"b.{key}").alias("r")).distinct()
    s = sets.select(group, key, "s")
    met = met.alias("m").join(s.alias("x"), F.col(f"m.{group}").eqNullSafe(F.col(f"x.{group}")) & (F.col("l") == F.col(f"x.{key}"))).select("m.*", F.col("x.s").alias("sl"))
    met = met.alias("m").join(s.alias("y"), F.col(f"m.{group}").eqNullSafe(F.col(f"y.{group}")) & (F.col("r") == F.col(f"y.{key}"))).select("m.*", F.col("y.s").alias("sr"))
    out = met.select(group, "l", "r", F.size(F.array_intersect("sl", "sr")).alias("shared"), F.size("sl").alias("n_l"), F.size("sr").alias("n_r"))
    alike = F.col("shared") >= F.lit(least - 1e-9) * (F.col("n_l") + F.col("n_r") - F.col("shared"))
    return out.where(alike if enough is None else alike | (F.col("shared") >= enough))


def similar_to(left: DataFrame, right: DataFrame, key: str, other: str, least: float) -> DataFrame:
    """(key, s array<string>), (other, s) to key, other, similarity: all pairs of a row of the left and one of the right whose
    Jaccard similarity is `least` or more; rows of one side never meet. Exact as similar_sets() is: values are ordered from the
    rarest of both sides up, and only the first n - ceil(least n) + 1 of each set make candidates. Empty and null sets and
    null keys are similar to nothing."""
    sides = [(left, key), (right, other)]
    each = [d.where(f"size(s) > 0 and {k} is not null").select(F.col(k).alias("k"), F.size("s").alias("n"), F.explode("s").alias("h")) for d, k in sides]
    often = each[0].select("h").union(each[1].select("h")).groupBy("h").agg(F.count("*").alias("f"))
    rare = Window.partitionBy("k").orderBy("f", "h")
    l, r = (kept(e.join(often, "h").withColumn("i", F.row_number().over(rare)).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1)).alias(x) for e, x in zip(each, "lr"))
    met = l.join(r, (F.col("l.h") == F.col("r.h")) & (F.least("l.n", "r.n") >= F.lit(least - 1e-9) * F.greatest("l.n", "r.n"))).select(F.col("l.k").alias("a"), F.col("r.k").alias("b")).distinct()
    met = met.join(left.select(F.col(key).alias("a"), F.col("s").alias("sl")), "a").join(right.select(F.col(other).alias("b"), F.col("s").alias("sr")), "b")
    shared = F.size(F.array_intersect("sl", "sr"))
    out = met.select(F.col("a").alias(key), F.col("b").alias(other), (shared / (F.size("sl") + F.size("sr") - shared)).alias("similarity"))
    return out.where(F.col("similarity") >= least - 1e-9)


def greedy(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(keys, a, b, ...) to the edges that a greedy one-to-one matching takes: smallest first by `order` (which must leave no ties
    within keys), each a and each b of a group once.

    An edge that is the best of both its ends is taken by the greedy walk whatever else there is; each round takes all
    of those and removes what they block. Rounds end when no edge is left; each is written to the shared folder. No
    group is ever one task's.
    """
    left, taken = kept(edges.withColumns({f"_o{i}": x for i, x in enumerate(order)})), None
    while not left.isEmpty():
        # the least of an order's columns by an aggregate, which is combined before the shuffle
        names = [f"_o{i}" for i in range(len(order))]
        first = lambda side: left.groupBy(*keys, side).agg(F.min(F.struct(*names)).alias("_first")).alias("f")
        best = left.alias("e")
        for side in ("a", "b"):
            best = best.join(first(side), same("e", "f", *keys, side) & (F.struct(*[F.col(f"e.{n}") for n in names]) == F.col("_first")), "left_semi").alias("e")
        best = kept(best)
        taken = best if taken is None else taken.union(best)
        for side in ("a", "b"):
            left = left.alias("e").join(best.select(*keys, side).alias("t"), same("e", "t", *keys, side), "left_anti")
        left = kept(left)
    return edges.limit(0) if taken is None else taken.select(*edges.columns)


@F.pandas_udf(returnType=DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matched share of two strings' characters: 0 if either is empty or null, 1 if they are equal."""
    one = lambda x, y: 0.0 if not x or not y else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(returnType=DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """ratio() of two different texts; null where the characters in common, in any order, already rule `least` out."""
    pairs = ((difflib.SequenceMatcher(None, x, y), r) for x, y, r in zip(a, b, least))
    return pd.Series([m.ratio() if m.quick_ratio() >= r else None for m, r in pairs], dtype="float64")


def matched_texts(left: DataFrame, right: DataFrame, group: str, least: float) -> DataFrame:
    """(group, i, text) twice to group, a, b, ratio: texts of a group matched one to one, best ratio first, ties to the larger
    positions; equal texts are left to the exact comparison.

    No pair that reaches `least` is left out: pairs are ruled out by their lengths and by the characters they have in
    common only, both of which bound the ratio. Texts meet within a group and a band of lengths: of a pair, the
    longer has (2 - least) / least times the other's characters at most. Null and empty texts match nothing.
    """
    width = math.log((2 - least) / least * 1.01)  # a little more, so that rounding loses no pair at a bound
    band = F.floor(F.log(F.char_length("text").cast("double")) / width)
    some = lambda side, k: side.where("text <> ''").select(group, F.col("i").alias(k), F.col("text").alias(f"t{k}"), band.alias("band"))
    x, y = some(left, "a").alias("x"), some(right, "b").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("y")
    short, long = F.least(F.char_length("ta"), F.char_length("tb")), F.char_length("ta") + F.char_length("tb")
    p = x.join(y, same("x", "y", group) & (F.col("x.band") == F.col("y.band"))).where((F.col("ta") != F.col("tb")) & (2 * short >= F.lit(least) * long))
    scored = p.select(f"x.{group}", "a", "b", ratio_from("ta", "tb", F.lit(least)).alias("ratio")).where(F.col("ratio") >= least)
    return greedy(scored, [group], [-F.col("ratio"), -F.col("a"), -F.col("b")])


@query()
def fuzzy_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a conversation's user matched one to one with the assistant's."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    c = c.select("conv_id", "role", (F.col("turn") * 100_000 + F.col("p")).alias("i"), "text")
    return matched_texts(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", 0.5)


_MARKS = "SELECT l_orderkey AS page, l_quantity AS x, l_tax * 100 AS y, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax * 100, l_returnflag) AS i FROM lineitem"


@query(f"WITH RECURSIVE box AS ({_MARKS}), e AS (SELECT m.page, m.i AS a, n.i AS b, round(abs(m.x - n.x) + abs(m.y - n.y), 6) AS distance FROM box m JOIN box n ON m.page = n.page AND m.f = 'R' AND n.f <> 'R' WHERE abs(m.x - n.x) + abs(m.y - n.y) <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY distance, abs(a - b), a, b) AS k FROM e), w(page, k, sa, sb, a, b, distance, taken) AS (SELECT page, k, [a], [b], a, b, distance, true FROM r WHERE k = 1 UNION ALL SELECT r.page, r.k, CASE WHEN list_contains(sa, r.a) OR list_contains(sb, r.b) THEN sa ELSE list_append(sa, r.a) END, CASE WHEN list_contains(sa, r.a) OR list_contains(sb, r.b) THEN sb ELSE list_append(sb, r.b) END, r.a, r.b, r.distance, NOT (list_contains(sa, r.a) OR list_contains(sb, r.b)) FROM w JOIN r ON r.page = w.page AND r.k = w.k + 1) SELECT page, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, distance FROM w WHERE taken")
def greedy_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of a page (an order) matched to its nearest anchors within reach, one to one: an interval join on cells of
    the reach's width, then the greedy matching by distance, difference of positions, positions."""
    reach = 10.0
    box = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), "l_returnflag", "l_partkey", "l_suppkey")
    box = box.withColumn("i", F.row_number().over(Window.partitionBy("page").orderBy("i", "l_partkey", "l_suppkey", "x", "y", "l_returnflag"))).drop("l_partkey", "l_suppkey")
    cell = F.floor(F.col("x") / reach)
    a = box.where("l_returnflag = 'R'").withColumn("c", F.explode(F.array(cell - 1, cell, cell + 1))).alias("m")
    b = box.where("l_returnflag <> 'R'").withColumn("c", cell).alias("n")
    d = F.abs(F.col("m.x") - F.col("n.x")) + F.abs(F.col("m.y") - F.col("n.y"))
    edges = a.join(b, (F.col("m.page") == F.col("n.page")) & (F.col("m.c") == F.col("n.c"))).where(d <= reach).select("m.page", F.col("m.i").alias("a"), F.col("n.i").alias("b"), F.round(d, 6).alias("distance"))
    return greedy(edges, ["page"], [F.col("distance"), F.abs(F.col("a") - F.col("b")), F.col("a"), F.col("b")])


_PAIRS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substring({0}, i, 2)))"


@query(f"WITH a AS (SELECT conv_id, turn, text AS ask FROM conversations WHERE role = 'user'), l0 AS (SELECT conv_id, turn - 1 AS turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations WHERE role = 'assistant'), p AS (SELECT conv_id, turn, pos, line, round(len(list_intersect({_PAIRS.format('ask')}, {_PAIRS.format('line')}))::DOUBLE / len({_PAIRS.format('line')}) + CASE WHEN contains(ask, line) THEN 0.45 ELSE 0.0 END, 9) AS score FROM a JOIN l0 USING (conv_id, turn) WHERE line <> ''), b AS (SELECT conv_id, turn, arg_max({{'pos': pos, 'line': line, 'score': score}}, (score, -pos)) AS x FROM p GROUP BY 1, 2) SELECT conv_id, turn, CAST(x.pos AS INTEGER) AS \"at\", x.line AS line, x.score AS score FROM b")
def best_match_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's text, the assistant's line that answers it best: pairs of characters in common, and more if
    the one holds the other; ties to the first line."""
    c = table(spark, sf_dir, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ask"))
    line = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.posexplode(F.split("text", "\n")).alias("at", "line")).where("line <> ''")
    pair = ask.join(line, ["conv_id", "turn"])
    a, b = bigrams(F.col("ask")), bigrams(F.col("line"))
    score = F.round(F.size(F.array_intersect(a, b)) / F.size(b) + F.when(F.col("ask").contains(F.col("line")), 0.45).otherwise(0.0), 9)
    pair = pair.select("conv_id", "turn", "at", "line", score.alias("score"))
    best = F.max_by(F.struct("at", "line", "score"), F.struct("score", -F.col("at"))).alias("x")
    return pair.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", "x.at", "x.line", "x.score")


_NAMED = "(SELECT p_brand, min(p_partkey) AS k, list_distinct(list_transform(range(1, greatest(length(p_name), 2)), lambda i: substring(p_name, i, 2))) AS g FROM part GROUP BY p_brand, p_name)"


@query(f"SELECT a.p_brand, a.k AS l, b.k AS r, len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) AS similarity FROM {_NAMED} a JOIN {_NAMED} b ON a.p_brand = b.p_brand AND a.k < b.k WHERE len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) >= 0.5")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a brand's different names by the Jaccard similarity of their character pairs; each name stands as its
    smallest part."""
    name = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("k"))
    pairs = similar_sets(name.select("p_brand", "k", bigrams(F.col("p_name")).alias("s")), "p_brand", "k", 0.5)
    return pairs.select("p_brand", "l", "r", (F.col("shared") / (F.col("n_l") + F.col("n_r") - F.col("shared"))).alias("similarity"))


@query("WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) SELECT query_id, vec_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM p) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cosine_blocks(v.where("vec_id % 20 = 0"), v, 10).select("query_id", "vec_id", "rank")

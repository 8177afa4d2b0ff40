"""Numbers, money, dates, rules and vectors as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def compare(left: Column, operator: Column, right: Column) -> Column:
    """left operator right, where the operator is a value; unknown ones mean at least."""
    return F.when(operator == "<=", left <= right).when(operator == "<", left < right).when(operator == ">", left > right).when(operator == "==", F.abs(left - right) < 1e-9).otherwise(left >= right)


@query(r"SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS number FROM part")
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.try_to_number(F.nullif(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("")), F.lit("999999999")).cast("long").alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN floor(o_totalprice / 10000) ELSE floor(o_totalprice) END AS amount, CASE WHEN o_totalprice >= 100000 THEN '万' ELSE '元' END AS unit FROM orders")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in units of ten thousand from 100,000 on."""
    big = F.col("o_totalprice") >= 100_000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(big, F.floor(F.col("o_totalprice") / 10_000)).otherwise(F.floor("o_totalprice")).cast("double").alias("amount"), F.when(big, "万").otherwise("元").alias("unit"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN l_discount <= l_tax WHEN 'N' THEN l_discount < l_tax ELSE l_discount >= l_tax END AS holds FROM lineitem")
def rule_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "A", "<=").when(F.col("l_returnflag") == "N", "<").otherwise("at least")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", compare(F.col("l_discount"), op, F.col("l_tax")).alias("holds"))


@query("SELECT o_orderkey, TRY_CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m-%d') AS said FROM orders")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_to_date(F.regexp_extract(said, "(20[0-9]{2}|19[0-9]{2})-[0-9]{2}-[0-9]{2}", 0), "yyyy-MM-dd").alias("day"), said.alias("said"))


def cosine_blocks(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(vec_id, embedding) twice to query_id, vec_id, similarity, rank: the k most similar other vectors of each query, ties to
    the smaller vec_id. Exact.

    Both sides are packed into blocks of about `block` rows by a hash of vec_id, so nothing is broadcast and a task
    holds two blocks; it multiplies them as matrices and keeps k for each query. Null ids and vectors are left
    out; a vector of zeros is similar to nothing (0).
    """
    if queries.isEmpty() or vectors.isEmpty():
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")

    def packed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        df = df.where("vec_id is not null and embedding is not null")
        parts = max(1, -(-df.count() // block))
        rows = df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(name)).agg(F.collect_list(F.struct("vec_id", "embedding")).alias(f"{name}_rows"))
        return rows, parts

    q, n_q = packed(queries, "q")
    v, _ = packed(vectors, "v")
    met = v.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(q, "q")

    def best(batches):
        for frame in batches:
            for qs, vs in zip(frame["q_rows"], frame["v_rows"]):
                unit = lambda rows: _unit(np.array([r["embedding"] for r in rows], dtype="float64"))
                qid, vid = np.array([r["vec_id"] for r in qs]), np.array([r["vec_id"] for r in vs])
                near = np.round(unit(qs) @ unit(vs).T, 6)
                near[qid[:, None] == vid[None, :]] = -np.inf
                first = np.lexsort((np.broadcast_to(vid, near.shape), -near), axis=1)[:, :k]
                out = pd.DataFrame({"query_id": np.repeat(qid, first.shape[1]), "vec_id": vid[first].ravel(), "similarity": np.take_along_axis(near, first, 1).ravel()})
                yield out[np.isfinite(out["similarity"])]

    few = met.select("q_rows", "v_rows").mapInPandas(best, "query_id long, vec_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

"""What the operators of this subpackage share: tables, the shared folder, words, whole-number keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import shared_dir

#: Separators of words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and kept in the shared folder: lineage ends here, and a lost
    executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def copies(rows: DataFrame, n: str, name: str, block: int = 1 << 14) -> DataFrame:
    """Each row n times (n is 1 or more), with its number from 0 in `name`. Rows with large n are made in blocks that are
    spread over tasks, so that a row repeated a billion times is neither one array nor one task's work."""
    last = F.col(n).cast("long") - 1
    many = rows.where(F.col(n) > block)
    few = rows.where(F.col(n) <= block).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if many.isEmpty():
        return few
    first = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(block).cast("long")))
    spread = many.withColumn(name, first).repartition(name)
    return few.unionByName(spread.withColumn(name, F.explode(F.sequence(F.col(name), F.least(last, F.col(name) + block - 1)))))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def md5_long(value: Column, digits: int = 15) -> Column:
    """The first hex digits of the MD5 of a string as a whole number; uniform, the same on every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")

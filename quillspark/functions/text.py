"""Text normalisation and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table

#: White space that separates nothing: blanks of ASCII, the no-break and the ideographic space.
BLANK = "[ \\t\\r\\n\\f\\x0B 　]+"
_BLANK_SQL = "'[ \\t\\r\\n\\f\\x0B 　]+'"


def norm(text: Column) -> Column:
    """One space for blanks within lines, LF for line ends, two at most, none at the ends."""
    t = F.translate(text, "　 ", "  ")
    t = F.regexp_replace(t, "\\r\\n?", "\n")
    t = F.regexp_replace(t, "[ \\t\\f\\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\\n{3,}", "\n\n"), "^[ \\n]+|[ \\n]+$", "")


def strip_serials(line: Column) -> Column:
    """A line without a leading serial that blanks follow: (12), 12., 3.1 or a), and the like."""
    return F.regexp_replace(line, "^[ \\t]*(?:\\([0-9]{1,3}\\)|[0-9]+(?:\\.[0-9]+)*[.)]?)[ \\t]+", "")


def compact(text: Column) -> Column:
    """The identity key of a text: no serials, no white space."""
    lines = F.transform(F.split(norm(text), "\n"), strip_serials)
    return F.regexp_replace(F.array_join(lines, ""), BLANK, "")


def bigrams(text: Column) -> Column:
    """The set of character pairs; a text of one or two characters is its own."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.char_length(text) <= 2, F.array(text)).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def clipped(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '　 ', '  '), '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0B]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
_KEY = "regexp_replace(array_to_string(list_transform(string_split(" + _NORM + ", chr(10)), lambda x: regexp_replace(x, '^[ \\t]*(?:\\([0-9]{1,3}\\)|[0-9]+(?:\\.[0-9]+)*[.)]?)[ \\t]+', '')), ''), " + _BLANK_SQL + ", '', 'g')"


@query("SELECT doc_id, " + _NORM + " AS norm FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", norm(F.col("text")).alias("norm"))


@query("SELECT doc_id, sha256(" + _KEY + ") AS key FROM documents")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(compact(F.col("text")), 256).alias("key"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS short FROM documents")
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clipped(F.col("text"), 80).alias("short"))


@query(r"SELECT doc_id, count(DISTINCT s) AS sentences FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([。！？!?；;])', '\1' || chr(10), 'g'), '\.( |$)', '.' || chr(10), 'g'), chr(10))) AS s FROM documents) WHERE s <> '' GROUP BY doc_id")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences of each document: boundaries after full stops and line ends."""
    t = F.regexp_replace(F.regexp_replace("text", "([。！？!?；;])", "$1\n"), "\\.( |\\z)", ".\n")
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(t, "\n")).alias("s")).where("s <> ''")
    return s.groupBy("doc_id").agg(F.countDistinct("s").alias("sentences"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS key FROM part")
def alnum_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]", "")).alias("key"))

"""Marked requirements of a text: chapters, entries that begin at a mark, what each must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.strings import HEADING, PUNCTUATION
from quillspark.functions.text import BLANK
from quillspark.plans.registry import query, table

#: What marks mandatory and bonus requirements.
MARKS = {"mandatory": "^[ \\t]*[★*]", "bonus": "^[ \\t]*[△▲]"}
#: Words of a chapter's title that say it holds requirements, and points for each; a chapter of less than none
#: is left out.
CHAPTERS = (("技术要求|采购需求|技术规格", 3), ("要求|参数|需求", 1), ("评分|评审|目录|合同", -5))


def marked(docs: DataFrame, marks: dict[str, str] = MARKS, heading: str = HEADING, chapters=CHAPTERS) -> DataFrame:
    """(doc_id, text, ...) to doc_id, line, chapter, kind, entry: the entries that begin at a line with a mark.

    An entry goes on over the following lines up to the next mark, heading or blank line; chapter is the title above it
    (empty before the first). Entries of chapters whose title speaks against requirements are left out, and of
    entries that say the same but for blanks and punctuation a document's first counts; line is its first line, from 0.
    Null texts have none; null doc_ids are one document. Other columns are ignored; empty gives empty.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("i", "line"))
    kind = F.lit(None).cast("string")
    for name, mark in reversed(marks.items()):
        kind = F.when(F.col("line").rlike(mark), name).otherwise(kind)
    is_head = F.col("kind").isNull() & F.col("line").rlike(heading)
    blank = F.regexp_replace("line", BLANK, "") == ""
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("kind").isNotNull() | is_head | blank
    placed = lines.withColumn("kind", kind).withColumns({"chapter": F.coalesce(F.last(F.when(is_head, F.col("line")), ignorenulls=True).over(w), F.lit("")), "at": F.coalesce(F.last(F.when(begins, F.col("i")), ignorenulls=True).over(w), F.lit(-1))})
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: F.trim(x["line"])), " ")  # the lines of one entry
    entry = placed.groupBy("doc_id", "at").agg(F.max("kind").alias("kind"), F.max("chapter").alias("chapter"), text.alias("entry")).where("kind is not null")
    score = sum((F.when(F.col("chapter").rlike(words), n).otherwise(0) for words, n in chapters), F.lit(0))
    key = entry_key(F.col("entry"))
    first = entry.where(score >= 0).groupBy("doc_id", "kind", key.alias("k")).agg(F.min(F.struct("at", "chapter", "entry")).alias("x"))
    return first.select("doc_id", F.col("x.at").alias("line"), F.col("x.chapter").alias("chapter"), "kind", F.col("x.entry").alias("entry"))


def entry_key(entry: Column) -> Column:
    """An entry without blanks, punctuation and marks."""
    return F.sha2(F.regexp_replace(F.regexp_replace(entry, PUNCTUATION, ""), "[ \\t\\r\\n★△▲]+", ""), 256)


_P = "'" + PUNCTUATION.replace("'", "''") + "'"
_KEY = f"sha256(regexp_replace(regexp_replace(entry, {_P}, '', 'g'), '[ \\t\\r\\n★△▲]+', '', 'g'))"
_BLANKS = "'" + BLANK + "'"


@query(f"WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT *, CASE WHEN regexp_matches(line, '^[EÉ]') THEN 'mandatory' WHEN regexp_matches(line, '^[UI]') THEN 'bonus' END AS kind FROM l), h AS (SELECT *, kind IS NULL AND regexp_matches(line, '^[A-D]') AS is_head FROM k), p AS (SELECT *, coalesce(last_value(CASE WHEN is_head THEN line END IGNORE NULLS) OVER w, '') AS chapter, coalesce(last_value(CASE WHEN kind IS NOT NULL OR is_head OR regexp_replace(line, {_BLANKS}, '', 'g') = '' THEN i END IGNORE NULLS) OVER w, -1) AS pos FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)), e AS (SELECT doc_id, pos, max(kind) AS kind, max(chapter) AS chapter, string_agg(trim(line), ' ' ORDER BY i) AS entry FROM p GROUP BY 1, 2 HAVING max(kind) IS NOT NULL) SELECT doc_id, CAST(pos AS INTEGER) AS line, chapter, kind, entry FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, {_KEY} ORDER BY pos) AS n FROM e) WHERE n = 1")
def marked_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the documents, with letters that begin a line as marks."""
    return marked(table(spark, sf_dir, "documents"), {"mandatory": "^[EÉ]", "bonus": "^[UI]"}, "^[A-D]")

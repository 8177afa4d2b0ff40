"""Tables of pages: what a column holds, and tables that go on over pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table

#: Words in a header that say what a column holds, in the order in which they decide.
ROLES = {"total": "合计|总价|total|amount", "price": "单价|price|cost", "quantity": "数量|qty|quantity|count", "item": "名称|项目|name|item|product"}
NUMBER = "^[-+¥$€£]?[0-9][0-9,]*(?:[.][0-9]+)?[%％]?$"
#: Share of a column's filled cells that must be numbers for it to count as one of numbers.
MOSTLY = 0.6
#: Pages between a table and one that goes on without a header, and columns by which they may differ.
PAGES_APART, COLUMNS_APART = 3, 2
LOGICAL = "doc string, page long, tab int, logical int, header string"


def column_roles(cells: DataFrame) -> DataFrame:
    """(page_id, tab, row, col, is_header, text) to page_id, tab, col, role: by the header's words, else `number` or `text` by what
    most filled cells are, `empty` without any. Null texts are empty cells; rows that repeat a cell count again."""
    text = F.lower(F.coalesce("text", F.lit("")))
    head = F.coalesce(F.col("is_header"), F.lit(False))
    role = F.lit(None).cast("string")
    for name, words in reversed(ROLES.items()):
        role = F.when(F.bool_or(head & text.rlike(words)), name).otherwise(role)
    filled, number = F.count_if(~head & (text != "")), F.count_if(~head & text.rlike(NUMBER))
    content = F.when(filled == 0, "empty").when(number >= MOSTLY * filled, "number").otherwise("text")
    return cells.groupBy("page_id", "tab", "col").agg(F.coalesce(role, content).alias("role"))


def headers(cells: DataFrame) -> DataFrame:
    """Cells to a row for each table: page_id, tab, header (its header cells' letters and digits in lower case, joined by |; empty
    without any), columns, numbers (whether a cell holds a number)."""
    key = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+", "")
    said = F.collect_set(F.when(F.col("is_header"), F.struct("row", "col", key.alias("k"))))  # the header of one table
    return cells.groupBy("page_id", "tab").agg(F.array_join(F.transform(F.sort_array(said), lambda x: x["k"]), "|").alias("header"), (F.max("col") + 1).alias("columns"), F.bool_or(~F.col("is_header") & F.coalesce("text", F.lit("")).rlike(NUMBER)).alias("numbers"))


def _alike(a: str, b: str) -> bool:
    """Two headers of which most words are the same, place by place."""
    x, y = a.split("|"), b.split("|")
    return len(x) == len(y) and 3 * sum(p == q for p, q in zip(x, y)) >= 2 * len(x)


def fold(tables: Iterator[tuple]) -> Iterator[tuple]:
    """Tables (doc, page, tab, header, columns, numbers) in order to (doc, page, tab, logical, header). A table goes on with the one
    before it if the same or a like header stands on the same or the next page, or if it has no header but numbers, is
    PAGES_APART pages away at most and differs from the whole table by COLUMNS_APART columns at most. What is
    compared is the table as merged so far: its first header, its widest row, its last page."""
    open_doc, logical, head, width, last = None, -1, "", 0, 0
    for doc, page, tab, header, columns, numbers in tables:
        if logical < 0 or doc != open_doc:
            open_doc, logical, goes_on = doc, 0, False
            first = True
        else:
            first = False
            near = page - last
            goes_on = (bool(header) and near <= 1 and (header == head or _alike(header, head))) or (not header and bool(numbers) and near <= PAGES_APART and abs(columns - width) <= COLUMNS_APART)
        if goes_on:
            width = max(width, columns)
        else:
            logical += 0 if first else 1
            head, width = header, columns
        last = page
        yield doc, page, tab, logical, head


def logical_tables(tables: DataFrame) -> DataFrame:
    """(doc string, page long, tab int, header, columns, numbers, ...) to doc, page, tab, logical (numbered from 0 in each
    document), header: see fold(). A document's tables stream by in order through one task, which keeps a header and three
    numbers of the table that is open. A null doc is an empty one; null pages come first, as page 0. Empty gives empty."""
    ordered = tables.select(F.coalesce("doc", F.lit("")).alias("doc"), F.coalesce("page", F.lit(0)).cast("long").alias("page"), F.coalesce("tab", F.lit(0)).cast("int").alias("tab"), F.coalesce("header", F.lit("")).alias("header"), F.coalesce("columns", F.lit(0)).cast("int").alias("columns"), F.coalesce("numbers", F.lit(False)).alias("numbers"))
    ordered = ordered.repartition("doc").sortWithinPartitions("doc", "page", "tab", "header", "columns", "numbers")

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in batch.itertuples(index=False, name=None))
        out = []
        for row in fold(rows):
            out.append(row)
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["doc", "page", "tab", "logical", "header"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["doc", "page", "tab", "logical", "header"])

    return ordered.mapInPandas(merged, LOGICAL)


@query("SELECT DISTINCT user_id AS page_id, 0 AS tab, col, role FROM events, (VALUES (0, 'number'), (1, 'text'), (2, 'price'), (3, 'empty')) r(col, role)")
def table_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table for each user, whose rows are events."""
    cell = lambda col, head, text: F.struct(F.lit(col).alias("col"), F.lit(head).alias("is_header"), text.cast("string").alias("text"))
    row = F.array(cell(0, False, F.col("value")), cell(1, False, F.col("event_type")), cell(2, True, F.lit("Unit price")), cell(3, False, F.lit("")))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.lit(0).alias("tab"), F.col("event_id").alias("row"), F.inline(row))
    return column_roles(e)


@query()
def multi_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that go on over an order's pages; its lines stand for them."""
    header = F.when(F.col("l_tax") > 0.02, F.concat_ws("|", "l_linestatus", F.when(F.col("l_discount") > 0.05, "x").otherwise("y"), F.lit("z"))).otherwise("")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("tab"), header.alias("header"), (F.col("l_quantity") / 10).cast("int").alias("columns"), (F.col("l_returnflag") != "N").alias("numbers"))
    return logical_tables(t)

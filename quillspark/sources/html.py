"""Text and tables of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import query, table

#: A cell spans this many rows or columns at most, as HTML has it.
MOST_SPAN = 1000
CELLS = "page_id long, tab int, row int, col int, is_header boolean, text string"
_GONE = "(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->"
#: The entities that pages hold most, and what they stand for; the ampersand is last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def page_text(html: Column) -> Column:
    """What a reader sees: no scripts, styles, comments and tags, entities resolved, one space for blanks."""
    t = F.regexp_replace(F.regexp_replace(html, _GONE, " "), "<[^>]*>", " ")
    for name, sign in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " "))


class _Tables(HTMLParser):
    """Collects the cells of all tables, inner ones too, with their spans."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[int] = []
        self.cells: list[list | None] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
            self.cells.append(None)
        elif self.open and tag == "tr":
            self.cells[-1] = None
            self.tables[self.open[-1]].append([])
        elif self.open and tag in ("td", "th"):
            rows = self.tables[self.open[-1]]
            if not rows:
                rows.append([])
            span = {k: int(v) if (v or "").strip().isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            size = [max(1, min(MOST_SPAN, span.get(k, 1))) for k in ("rowspan", "colspan")]
            self.cells[-1] = ["", tag == "th", *size]
            rows[-1].append(self.cells[-1])
        elif tag == "br" and self.open and self.cells[-1] is not None:
            self.cells[-1][0] += " "

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
            self.cells.pop()
        elif tag in ("td", "th", "tr") and self.open:
            self.cells[-1] = None

    def handle_data(self, data):
        if self.open and self.cells[-1] is not None:
            self.cells[-1][0] += data


def parse_tables(html: str | None) -> Iterator[tuple[int, int, int, bool, str]]:
    """(table, row, column, is_header, text) of each cell of the dense grids: a cell that spans fills all it spans."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    for t, rows in enumerate(parser.tables):
        taken: dict[tuple[int, int], list] = {}
        for r, cells in enumerate(rows):
            c = 0
            for cell in cells:
                while (r, c) in taken:
                    c += 1
                for down in range(min(cell[2], len(rows) - r)):
                    for right in range(cell[3]):
                        taken.setdefault((r + down, c + right), cell)
                c += cell[3]
        for (r, c), cell in sorted(taken.items()):
            yield t, r, c, cell[1], " ".join(cell[0].split())


def table_cells(pages: DataFrame) -> DataFrame:
    """(page_id, html, ...) to a row for each cell of each table. Null and tableless pages give none."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            for page_id, html in zip(pages["page_id"], pages["html"]):
                if rows := [(page_id, *x) for x in parse_tables(html)]:
                    yield pd.DataFrame(rows, columns=["page_id", "tab", "row", "col", "is_header", "text"])

    return pages.where("html like '%<table%' or html like '%<TABLE%'").select("page_id", "html").mapInPandas(cells, CELLS)


def records(cells: DataFrame) -> DataFrame:
    """Cells to records: page_id, tab, row, record (header to text). A column's header joins its different header cells from the top;
    without one it is its number; of columns of one header the first counts."""
    head = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_set(F.when(F.col("is_header"), F.struct("row", "text")))), lambda x: x["text"])), " ")
    heads = cells.groupBy("page_id", "tab", "col").agg(head.alias("h")).select("page_id", "tab", "col", F.when(F.col("h") == "", F.col("col").cast("string")).otherwise(F.col("h")).alias("h"))
    first = cells.where("not is_header").join(heads, ["page_id", "tab", "col"]).groupBy("page_id", "tab", "row", "h").agg(F.min_by("text", "col").alias("text"))
    return first.groupBy("page_id", "tab", "row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("h", "text")))).alias("record"))


_SQL = "regexp_replace(regexp_replace(html, '" + _GONE + "', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _name, _sign in ENTITIES.items():
    _SQL = f"replace({_SQL}, '{_name}', '" + _sign.replace("'", "''") + "')"


@query(f"SELECT page_id, trim(regexp_replace({_SQL}, '[ \\t\\r\\n]+', ' ', 'g')) AS said FROM pages")
def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("said"))


@query()
def html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_cells(table(spark, sf_dir, "pages"))

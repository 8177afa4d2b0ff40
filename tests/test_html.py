from quillspark.sources.html import page_text, parse_tables, records, table_cells
from pyspark.sql import functions as F

GRID = """<table><tr><th rowspan=2>Item</th><th colspan="2">Price</th></tr><tr><th>net</th><th>gross</th></tr>
<tr><td>Bolt<td>1,00<td>1,19</tr><tr><td colspan='3'>a<br>b &amp; c</td></tr></table>"""


def test_grids_are_dense():
    cells = {(r, c): (h, t) for _, r, c, h, t in parse_tables(GRID)}
    assert len(cells) == 12 and cells[0, 0] == cells[1, 0] == (True, "Item") and cells[0, 2] == (True, "Price")
    assert [cells[2, c][1] for c in range(3)] == ["Bolt", "1,00", "1,19"] and cells[3, 2] == (False, "a b & c")


def test_inner_and_broken_tables():
    cells = list(parse_tables("<table><tr><td>a<table><tr><td>b</table>c</td></tr><td>d<tr><td rowspan=99>e"))
    assert [(t, r, c, x) for t, r, c, _, x in cells] == [(0, 0, 0, "ac"), (0, 0, 1, "d"), (0, 1, 0, "e"), (1, 0, 0, "b")]
    assert not list(parse_tables(None)) and not list(parse_tables("")) and not list(parse_tables("<td>x"))
    assert [x[4] for x in parse_tables('<table><tr><td rowspan="0" colspan="x">y')] == ["y"]


def test_records_of_pages(spark):
    pages = spark.createDataFrame([(1, GRID, "x"), (2, None, "y"), (3, "<p>none</p>", "z")], "page_id long, html string, tab string")
    got = {r.row: r.record for r in records(table_cells(pages)).collect()}
    assert got[2] == {"Item": "Bolt", "Price net": "1,00", "Price gross": "1,19"} and set(got) == {2, 3}
    assert table_cells(pages.limit(0)).isEmpty()


def test_text_of_pages(spark):
    html = "<style>p{}</style><p>a&nbsp;&lt;b&gt;<script>x='</p>'</script><!-- no --> c\n\td &amp;lt;"
    got = [r.t for r in spark.createDataFrame([(html,), ("",), (None,)], "h string").select(page_text(F.col("h")).alias("t")).collect()]
    assert got == ["a <b> c d &lt;", "", None]

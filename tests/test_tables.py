from quillspark.plans import catalog
from quillspark.plans.requirements import marked
from quillspark.sources.html import table_cells
from quillspark.sources.tables import column_roles, fold, headers, logical_tables

SF = "/root/testdata/sf0.001"


def test_tables_that_go_on(spark):
    rows = [
        ("a", 1, 0, "no|name|price", 3, True),
        ("a", 2, 0, "no|name|price", 3, True),  # the same header, next page
        ("a", 3, 0, "no|name|cost", 3, True),  # a like one
        ("a", 5, 0, "", 4, True),  # no header, two pages on
        ("a", 6, 0, "", 9, True),  # too wide
        ("a", 6, 1, "", 9, False),  # no numbers
        ("a", 9, 0, "no|name|price", 3, True),
        ("a", 11, 0, "no|name|price", 3, True),  # a page between
        ("b", 12, 0, "no|name|price", 3, True),
        (None, None, None, None, None, None),
    ]
    want = [("", 0, 0, 0)] + [("a", p, t, n) for (p, t), n in zip([(1, 0), (2, 0), (3, 0), (5, 0), (6, 0), (6, 1), (9, 0), (11, 0)], [0, 0, 0, 0, 1, 2, 3, 4])] + [("b", 12, 0, 0)]
    d = spark.createDataFrame(rows[::-1], "doc string, page long, tab int, header string, columns int, numbers boolean")
    assert sorted(tuple(r)[:4] for r in logical_tables(d).collect()) == want
    assert logical_tables(d.limit(0)).isEmpty() and list(fold(iter([]))) == []


def test_roles(spark):
    cells = [(1, 0, 0, 0, True, "Unit Price"), (1, 0, 1, 0, False, "abc"), (1, 0, 0, 1, True, "Code"), (1, 0, 1, 1, False, "1,200.5"), (1, 0, 2, 1, False, "7%"), (1, 0, 3, 1, False, "x"), (1, 0, 1, 2, False, "red"), (1, 0, 1, 3, None, None)]
    d = spark.createDataFrame(cells, "page_id long, tab int, row int, col int, is_header boolean, text string")
    assert {r.col: r.role for r in column_roles(d).collect()} == {0: "price", 1: "number", 2: "text", 3: "empty"}
    assert column_roles(d.limit(0)).isEmpty()


def test_headers_of_parsed_cells(spark):
    html = "<table><tr><th>No.</th><th>Unit Price</th></tr><tr><td>1</td><td>5.0</td></tr></table><table><tr><td>x</td><td>y</td><td>z</td></tr></table>"
    cells = table_cells(spark.createDataFrame([(1, html), (2, "none"), (3, None)], "page_id long, html string"))
    assert sorted(map(tuple, headers(cells).collect())) == [(1, 0, "no|unitprice", 2, True), (1, 1, "", 3, False)]


def test_registered_tables_are_brute_force(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    rows = [(str(r.l_orderkey), r.l_linenumber, r.l_partkey, f"{r.l_linestatus}|{'x' if r.l_discount > 0.05 else 'y'}|z" if r.l_tax > 0.02 else "", int(r.l_quantity / 10), r.l_returnflag != "N") for r in lines]
    want, state = [], {}
    for doc, page, tab, header, columns, numbers in sorted(rows):
        n, head, width, last = state.get(doc, (-1, None, 0, 0))
        same = sum(a == b for a, b in zip(header.split("|"), (head or "").split("|"))) >= 2
        on = n >= 0 and ((header and head and page - last <= 1 and same) or (not header and numbers and page - last <= 3 and abs(columns - width) <= 2))
        state[doc] = (n, head, max(width, columns), page) if on else (n + 1, header, columns, page)
        want.append((doc, page, tab, *state[doc][:2]))
    got = catalog.QUERIES["multi_page_tables"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.logical for r in got}) > 2


def test_marked_requirements(spark):
    text = "★ before any chapter\n第一章 技术要求\n★1. must have\n  two lines\n△ nice to have\n\nnot part of it\n★1, must have two lines\n第二章 评分办法\n★ is not asked for"
    d = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (None, "★ alone", "x")], "doc_id long, text string, chapter string")
    got = {tuple(r) for r in marked(d).collect()}
    assert got == {(1, 0, "", "mandatory", "★ before any chapter"), (1, 2, "第一章 技术要求", "mandatory", "★1. must have two lines"), (1, 4, "第一章 技术要求", "bonus", "△ nice to have"), (None, 0, "", "mandatory", "★ alone")}
    assert marked(d.limit(0)).isEmpty()

import zlib

from quillspark.sources.pdf import Pdf, items, read_items, read_meta, spans, written


def test_round_trip():
    pdf = Pdf(written([[(72, 700, "naïve (a)"), (72, 650, "第二行")], []], {"Author": "Ä B"}))
    assert [(p, t, x) for p, _, t, x, *_ in items(pdf)] == [(1, "text", "naïve (a)"), (1, "text", "第二行")] and len(pdf.pages()) == 2


def test_operators_of_text():
    """Simple fonts, arrays with kerning, moves, nested transformations, octal escapes, several content streams."""
    show = b"q 2 0 0 2 10 20 cm BT /F 5 Tf 10 TL 5 5 Td (A\\(b\\)\\101) Tj T* [(x) -2000 (y)] TJ ET Q BT /F 9 Tf 1 0 0 1 300 300 Tm (plain) Tj (line) ' ET"
    body = zlib.compress(show)
    objects = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [3 0 R] /Resources << /Font << /F 5 0 R >> >> >> endobj", b"3 0 obj << /Type /Page /Contents [4 0 R 6 0 R] >> endobj", b"4 0 obj << /Filter /FlateDecode /Length %d >> stream\r\n%s\r\nendstream endobj" % (len(body), body), b"5 0 obj << /Type /Font /Subtype /Type1 >> endobj", b"6 0 obj << /Length 40 >> stream\nBT /F 9 Tf 1 0 0 1 50 500 Tm (more) Tj ET\nendstream endobj"]
    pdf = Pdf(b"%PDF-1.4\n" + b"\n".join(objects))
    found = [(round(x), round(y), t) for x, y, _, _, t in spans(pdf, pdf.pages()[0])]
    assert found == [(20, 30, "A(b)A"), (20, 10, "x"), (45, 10, "y"), (300, 300, "plain"), (300, 290, "line"), (50, 500, "more")]


def test_objects_in_streams():
    inner = b"1 0 2 34 << /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] >>"
    first = len(b"1 0 2 34 ")
    body = zlib.compress(inner)
    data = b"%%PDF-1.5\n9 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n3 0 obj << /Type /Page >> endobj\n8 0 obj << /Type /XRef /Root 1 0 R >> endobj" % (first, len(body), body)
    assert len(Pdf(data).pages()) == 1


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"no pdf at all ( << [")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(written([[(1, 1, "ok")]]).replace(b"FlateDecode", b"LZWDecode"))
    (tmp_path / "d.txt").write_bytes(b"other")
    assert read_items(spark, str(tmp_path)).isEmpty()
    assert sorted(map(tuple, read_meta(spark, str(tmp_path)).collect())) == [("a.pdf", 0, None, None), ("c.pdf", 1, None, None)]

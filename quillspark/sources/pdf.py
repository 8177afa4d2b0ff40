"""PDF files with a text layer: lines with their boxes, tables, images and who made the file, read in Arrow batches.

A file is one row of Spark's binaryFile source, so files are spread over tasks. Read are classic and compressed objects,
Flate streams, simple and Unicode-mapped fonts; encrypted files, scans and other filters give no text.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.registry import kept_folder, query

ITEMS = "file string, page int, seq int, type string, text string, x0 double, y0 double, x1 double, y1 double"
#: Images count from so many pixels on a side and in all.
LEAST_SIDE, LEAST_PIXELS = 80, 20_000
#: Columns of a table stand within so many points below each other, and a gap of so many between texts parts two cells.
ALIGNED, GAP = 3.0, 12.0

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_TOKEN = re.compile(rb"<<|>>|\[|\]|/[^\s/<>\[\]()%{}]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|[^\s/<>\[\]()%{}]+", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_SIGNS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name such as /Type."""


class Ref(int):
    """A reference to an object."""


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    one = lambda m: _SIGNS.get(m[1]) or (b"" if m[1][-1:] == b"\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1])
    return _ESCAPE.sub(one, token[1:-1])


def _values(data: bytes) -> list:
    """The values of a piece of PDF: numbers, names, byte strings, lists, dictionaries, references, operators as bytes in a tuple."""
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(data):
        t = m[0]
        if t in (b"<<", b"["):
            stack.append([])
        elif t in (b">>", b"]"):
            if len(stack) == 1:
                continue
            done = stack.pop()
            stack[-1].append({k: v for k, v in zip(done[::2], done[1::2]) if isinstance(k, Name)} if t == b">>" else done)
        elif t[:1] == b"/":
            stack[-1].append(Name(t[1:].decode("latin-1")))
        elif t[:1] in b"(<":
            stack[-1].append(_string(t))
        elif t == b"R" and len(stack[-1]) >= 2:
            number = stack[-1][-2]
            stack[-1][-2:] = [Ref(number)]
        else:
            try:
                stack[-1].append(float(t) if b"." in t else int(t))
            except ValueError:
                stack[-1].append((t,))
    return stack[0]


class Pdf:
    """The objects of a file, by number. Later ones of a number replace earlier ones, as updates do."""

    def __init__(self, data: bytes):
        self.raw = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        self.trailers = [v for m in re.finditer(rb"trailer(.*?)startxref", data, re.S) for v in _values(m[1]) if isinstance(v, dict)]
        self.found: dict[int, object] = {}
        for number in list(self.raw):
            d = self[number]
            if isinstance(d, dict) and d.get("Type") == "ObjStm":
                body, first = self.stream(number), d.get("First", 0)
                heads = [x for x in _values(body[:first]) if isinstance(x, int)]
                for n, at, end in zip(heads[::2], heads[1::2], [*heads[3::2], len(body) - first]):
                    self.raw.setdefault(n, body[first + at : first + end])
            elif isinstance(d, dict) and d.get("Type") == "XRef":
                self.trailers.append(d)

    def __getitem__(self, number: int):
        if number not in self.found:
            body = self.raw.get(number, b"null").partition(b"stream")[0]
            self.found[number] = next(iter(_values(body)), None)
        return self.found[number]

    def get(self, value):
        for _ in range(8):
            if not isinstance(value, Ref):
                break
            value = self[value]
        return value

    def stream(self, number: int) -> bytes:
        """A stream's bytes, inflated; what cannot be read is empty."""
        head, found, body = self.raw.get(number, b"").partition(b"stream")
        if not found:
            return b""
        body = body.removeprefix(b"\r").removeprefix(b"\n")
        d = self[number]
        length = self.get(d.get("Length")) if isinstance(d, dict) else None
        body = body[:length] if isinstance(length, int) and length <= len(body) else body.rpartition(b"endstream")[0]
        kinds = self.get(d.get("Filter"))
        for kind in kinds if isinstance(kinds, list) else [kinds] if kinds else []:
            if kind != "FlateDecode":
                return b""
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                return b""
        return body

    def info(self) -> dict:
        for t in reversed(self.trailers):
            d = self.get(t.get("Info"))
            if isinstance(d, dict):
                return d
        return {}

    def pages(self) -> list[dict]:
        root = next((self.get(t["Root"]) for t in reversed(self.trailers) if "Root" in t), None) or next((d for n in self.raw if isinstance(d := self[n], dict) and d.get("Type") == "Catalog"), {})
        out, todo, seen = [], [(root.get("Pages"), {})], set()
        while todo:
            ref, inherited = todo.pop()
            d = self.get(ref)
            if not isinstance(d, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else None)
            d = inherited | d
            if "Kids" in d:
                todo += [(k, {"Resources": d["Resources"]} if "Resources" in d else {}) for k in reversed(self.get(d["Kids"]) or [])]
            else:
                out.append(d)
        return out


def text_of(value) -> str:
    """A string of a dictionary as text."""
    if not isinstance(value, bytes):
        return ""
    return value[2:].decode("utf-16-be", "replace") if value[:2] == b"\xfe\xff" else value.decode("latin-1")


def _mapping(cmap: bytes) -> dict[int, str]:
    out = {}
    sign = lambda b: b.decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        v = [x for x in _values(block) if isinstance(x, bytes)]
        out |= {int.from_bytes(a): sign(b) for a, b in zip(v[::2], v[1::2])}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        v = _values(block)
        for a, b, c in zip(v[::3], v[1::3], v[2::3]):
            for i in range(min(65_536, int.from_bytes(b) - int.from_bytes(a) + 1)):
                out[int.from_bytes(a) + i] = sign(c[i]) if isinstance(c, list) else chr(int.from_bytes(c) + i)
    return out


def _decoder(pdf: Pdf, font) -> tuple[int, dict[int, str] | None]:
    """Bytes of a character of a font, and what they stand for (None: Windows' Latin letters)."""
    font = pdf.get(font) or {}
    two = font.get("Subtype") == "Type0"
    cmap = font.get("ToUnicode")
    return (2 if two else 1), _mapping(pdf.stream(cmap)) if isinstance(cmap, Ref) else ({} if two else None)


def spans(pdf: Pdf, page: dict) -> list[tuple[float, float, float, float, str]]:
    """(x, baseline, width, size, text) of each text that a page shows, in the order of showing."""
    resources = pdf.get(page.get("Resources")) or {}
    fonts = {k: _decoder(pdf, v) for k, v in (pdf.get(resources.get("Font")) or {}).items()}
    parts = pdf.get(page.get("Contents"))
    refs = parts if isinstance(parts, list) else [page.get("Contents")]
    data = b"\n".join(pdf.stream(r) for r in refs if isinstance(r, Ref))
    out, args, saved = [], [], []
    ctm = tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    times = lambda a, b: (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])
    font, size, leading = (1, None), 1.0, 0.0

    def show(raw: bytes) -> None:
        nonlocal tm
        width, table = font
        codes = [int.from_bytes(raw[i : i + width]) for i in range(0, len(raw), width)]
        text = raw.decode("cp1252", "replace") if table is None else "".join(table.get(c, "") for c in codes)
        at = times(tm, ctm)
        wide = sum(1.0 if ord(c) > 0x2E7F else 0.5 for c in text) * size
        if text.strip():
            out.append((at[4], at[5], wide * abs(at[0]), size * abs(at[3]), text))
        tm = times((1, 0, 0, 1, wide, 0), tm)

    for v in _values(data):
        if not isinstance(v, tuple):
            args.append(v)
            continue
        op, n = v[0], [x for x in args if isinstance(x, int | float)]
        if op == b"q":
            saved.append(ctm)
        elif op == b"Q" and saved:
            ctm = saved.pop()
        elif op == b"cm" and len(n) == 6:
            ctm = times(tuple(n), ctm)
        elif op == b"BT":
            tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif op == b"Tf" and n:
            font, size = fonts.get(next((x for x in args if isinstance(x, Name)), ""), (1, None)), float(n[-1])
        elif op == b"TL" and n:
            leading = n[0]
        elif op in (b"Td", b"TD") and len(n) == 2:
            leading = -n[1] if op == b"TD" else leading
            tm = line = times((1, 0, 0, 1, n[0], n[1]), line)
        elif op == b"Tm" and len(n) == 6:
            tm = line = tuple(n)
        elif op in (b"T*", b"'", b'"'):
            tm = line = times((1, 0, 0, 1, 0, -leading), line)
        if op in (b"Tj", b"'", b'"'):
            show(next((x for x in reversed(args) if isinstance(x, bytes)), b""))
        elif op == b"TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, int | float):
                    tm = times((1, 0, 0, 1, -x * size / 1000, 0), tm)
        args = []
    return out


def lines(found: list[tuple[float, float, float, float, str]]) -> list[list[tuple[float, float, float, float, str]]]:
    """Spans by line, from the top down, and within a line from left to right; neighbours without a gap are one span."""
    rows: list[list] = []
    for s in sorted(found, key=lambda s: (-s[1], s[0])):
        if rows and abs(rows[-1][0][1] - s[1]) <= s[3] / 3:
            rows[-1].append(s)
        else:
            rows.append([s])
    out = []
    for row in rows:
        merged: list[tuple] = []
        for s in sorted(row):
            last = merged[-1] if merged else None
            if last and s[0] - last[0] - last[2] < GAP:
                space = " " if s[0] - last[0] - last[2] > s[3] / 5 and not last[4].endswith(" ") else ""
                merged[-1] = (last[0], last[1], s[0] + s[2] - last[0], max(last[3], s[3]), last[4] + space + s[4])
            else:
                merged.append(s)
        out.append(merged)
    return out


def items(pdf: Pdf) -> Iterator[tuple]:
    """(page, seq, type, text, box) of each line, table and large image. Lines below each other whose cells begin at the same
    places are the rows of a table: its text is its cells, parted by " | ", a line for each row."""
    for number, page in enumerate(pdf.pages(), 1):
        seq, rows = 0, lines(spans(pdf, page))
        at = 0
        while at < len(rows):
            end = at + 1
            same = lambda a, b: len(a) == len(b) > 1 and all(abs(x[0] - y[0]) <= ALIGNED for x, y in zip(a, b))
            while end < len(rows) and same(rows[at], rows[end]):
                end += 1
            block = rows[at:end]
            cells = [s for row in block for s in row]
            box = (min(s[0] for s in cells), min(s[1] for s in cells), max(s[0] + s[2] for s in cells), max(s[1] + s[3] for s in cells))
            text = "\n".join((" | " if end - at > 1 else " ").join(s[4].strip() for s in row) for row in block)
            yield (number, seq, "table" if end - at > 1 else "text", text, *(round(x, 2) for x in box))
            seq, at = seq + 1, end
        objects = pdf.get((pdf.get(page.get("Resources")) or {}).get("XObject")) or {}
        for ref in objects.values():
            d = pdf.get(ref)
            if isinstance(d, dict) and d.get("Subtype") == "Image" and isinstance(w := pdf.get(d.get("Width")), int) and isinstance(h := pdf.get(d.get("Height")), int):
                if min(w, h) >= LEAST_SIDE and w * h >= LEAST_PIXELS and (pixels := pdf.stream(ref)):
                    yield (number, seq, "image", hashlib.sha256(f"{w}x{h}rgb".encode() + pixels).hexdigest(), 0.0, 0.0, float(w), float(h))
                    seq += 1


def _read(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_py() or b""
            yield from of(path.rpartition("/")[2], Pdf(data))


def _items(file: str, pdf: Pdf) -> Iterator[pa.RecordBatch]:
    names = ["file", "page", "seq", "type", "text", "x0", "y0", "x1", "y1"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 4]
    found = [(file, *x) for x in items(pdf)]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)


def _meta(file: str, pdf: Pdf) -> Iterator[pa.RecordBatch]:
    d = pdf.info()
    said = [text_of(pdf.get(d.get(k))).strip().lower() or None for k in ("Author", "Creator")]
    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(pdf.pages())], pa.int32()), *(pa.array([x], pa.string()) for x in said)], ["file", "pages", "author", "creator"])


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The lines, tables and images of all PDF files of a folder. Files that cannot be read give no rows."""
    return files(spark, path).mapInArrow(lambda b: _read(b, _items), ITEMS)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """file, pages, author, creator (lower-cased; null if not stated) of all PDF files of a folder but empty ones."""
    return files(spark, path).mapInArrow(lambda b: _read(b, _meta), "file string, pages int, author string, creator string")


def written(pages: list[list[tuple[float, float, str]]], info: dict[str, str] | None = None, image: tuple[int, int, bytes] | None = None) -> bytes:
    """A PDF file of texts at places, in a font with a Unicode map; for fixtures."""
    signs = sorted({c for p in pages for _, _, t in p for c in t})
    code = {c: i + 1 for i, c in enumerate(signs)}
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange\n" + b"%d beginbfchar\n" % len(signs) + b"".join(b"<%04x> <%s>\n" % (code[c], c.encode("utf-16-be").hex().encode()) for c in signs) + b"endbfchar"
    stream = lambda body, more=b"": b"<< /Length %d /Filter /FlateDecode %s >> stream\n%s\nendstream" % (len(z := zlib.compress(body)), more, z)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", 4: stream(cmap)}
    x = b""
    if image:
        w, h, pixels = image
        objects[5] = stream(pixels, b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8" % (w, h))
        x = b"/XObject << /I 5 0 R >>"
    objects[6] = b"<< " + b" ".join(b"/%s <feff%s>" % (k.encode(), v.encode("utf-16-be").hex().encode()) for k, v in (info or {}).items()) + b" >>"
    kids = []
    for i, page in enumerate(pages):
        shown = b"\n".join(b"BT /F 10 Tf 1 0 0 1 %.2f %.2f Tm <%s> Tj ET" % (px, py, b"".join(struct.pack(">H", code[c]) for c in t).hex().encode()) for px, py, t in page)
        objects[10 + 2 * i], objects[11 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F 3 0 R >> %s >> >>" % (11 + 2 * i, x), stream(shown)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in sorted(objects.items())) + b"trailer << /Root 1 0 R /Info 6 0 R >>\nstartxref\n0\n%%EOF"


def _fixture(spark: SparkSession) -> str:
    """A folder with two files, written by a task so that any executor can read them."""
    bid = written([[(72, 700, "投标函"), (72, 680, "Total price"), (150, 680, "1,200 元")], [(72, 700, "序号"), (200, 700, "名称"), (72, 680, "1"), (200, 680, "水泵"), (72, 640, "end")]], {"Author": "Acme Ltd", "Creator": "Writer"}, (200, 100, bytes(60_000)))
    other = written([[(72, 700, "same author")]], {"Author": "ACME ltd"})
    path = kept_folder(spark, "pdf")
    rows = spark.createDataFrame([("bid.pdf", bid), ("other.pdf", other)], "name string, content binary")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)
        store.create_dir(root)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content)
            yield batch.select(["name"])

    rows.mapInArrow(put, "name string").count()
    return path


_IMAGE = hashlib.sha256(b"200x100rgb" + bytes(60_000)).hexdigest()


@query(f"SELECT * FROM (VALUES ('bid.pdf', 1, 0, 'text', '投标函'), ('bid.pdf', 1, 1, 'text', 'Total price 1,200 元'), ('bid.pdf', 1, 2, 'image', '{_IMAGE}'), ('bid.pdf', 2, 0, 'table', '序号 | 名称' || chr(10) || '1 | 水泵'), ('bid.pdf', 2, 1, 'text', 'end'), ('bid.pdf', 2, 2, 'image', '{_IMAGE}'), ('other.pdf', 1, 0, 'text', 'same author')) AS t(file, page, seq, type, text)")
def pdf_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_items(spark, _fixture(spark)).select("file", "page", "seq", "type", "text")


@query("SELECT 'bid.pdf' AS file, 0 AS tab, 0 AS row, ['序号', '名称'] AS cells UNION ALL SELECT 'bid.pdf', 0, 1, ['1', '水泵']")
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of tables as cells."""
    t = read_items(spark, _fixture(spark)).where("type = 'table'")
    return t.select("file", F.col("seq").alias("tab"), F.posexplode(F.split("text", "\n")).alias("row", "line")).select("file", "tab", "row", F.split("line", " [|] ").alias("cells"))


@query("SELECT 'acme ltd' AS author, 2::BIGINT AS files")
def pdf_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors that several files name."""
    return read_meta(spark, _fixture(spark)).where("author is not null").groupBy("author").agg(F.count("*").alias("files")).where("files > 1")


@query(f"SELECT '{_IMAGE}' AS digest, '1,2' AS pages")
def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image once, with the pages that show it."""
    i = read_items(spark, _fixture(spark)).where("type = 'image'")
    return i.groupBy(F.col("text").alias("digest")).agg(F.array_join(F.array_sort(F.collect_set(F.col("page").cast("string"))), ",").alias("pages"))

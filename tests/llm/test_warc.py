import gzip
import hashlib
import random

import pyarrow as pa

from quillspark.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, payload string"


def brute(rows):
    first = {}
    for p, _, h, *_ in rows:
        h = h or ""
        if len(h.encode()) >= 100 and p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first.get(h) is not None and first[h] != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def rows():
    big, small = "<p>é page</p>" * 30, "<p>small</p>"
    out = [(5, "http://a", big, "x", None), (3, "http://b\r\nX: y", big, None, None), (9, None, big, None, None), (9, None, big, None, None), (4, "u", small, None, None), (6, "u", small, None, None)]
    out += [(7, "u", None, None, None), (8, "u", "", None, None), (None, "u", big, None, None), (10, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n" * 20, None, None), (11, "u", "x" * 3_000_000, None, None), (-2, "u", "only one" * 50, None, None)]
    return out


def test_round_trip(spark, tmp_path):
    r = rows()
    warc.write(spark.createDataFrame(r, SCHEMA), str(tmp_path / "w"))
    got = warc.pages_of(warc.read(spark, str(tmp_path / "w"))).collect()
    assert sorted(map(tuple, got), key=str) == brute(r)


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows(), SCHEMA), path)
    heads = warc.read(spark, path, payload=False)
    assert heads.where("record_type = 'revisit'").count() == 4
    assert heads.where("record_type = 'response' and record_id = '<urn:page:4>'").collect()[0].payload is None
    assert warc.read(spark, path).where("record_id in ('<urn:page:4>', '<urn:page:3>')").count() == 2
    reader = warc.WarcReader(path, True)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 3)])) == [warc.EqualTo(("payload_bytes",), 3)]
    called = []
    reader._row(b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 5", lambda: called.append(1))
    assert called == []


def test_foreign_archives(spark, tmp_path):
    """Gzip members without skip lengths, and uncompressed files, without a manifest."""
    row = {"record_type": "response", "record_id": "<urn:page:1>", "target_uri": "u", "refers_to": None, "payload_digest": "0" * 64, "payload_bytes": 5000, "payload": b"\r\n\r\n" + b"z" * 4996}
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(row | {"record_id": f"<urn:page:{i}>"})) for i in range(5)))
    (tmp_path / "b.warc").write_bytes(b"".join(warc.record(row | {"record_id": f"<urn:page:{i}>"}) for i in range(5, 8)))
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in got) == [f"<urn:page:{i}>" for i in range(8)] and {bytes(r.payload) for r in got} == {row["payload"]}
    assert warc.read(spark, str(tmp_path)).where("record_id = '<urn:page:6>'").count() == 1


def test_a_second_write_adds_and_one_that_overwrites_replaces(spark, tmp_path):
    path, page = str(tmp_path / "w"), lambda i: spark.createDataFrame([(i, "u", "page of its own " * 20, None, None)], SCHEMA)
    for i in (1, 2):
        warc.write(page(i), path)
    ids = lambda: sorted(r.page_id for r in warc.pages_of(warc.read(spark, path)).collect())
    assert ids() == [1, 2]
    warc.write(page(3), path, "overwrite")
    assert ids() == [3] and len(list((tmp_path / "w").glob("part-*"))) <= 8


def test_header_names_have_no_case_and_may_be_folded(tmp_path):
    reader = warc.WarcReader(str(tmp_path), True)
    row = reader._row(b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <a>\r\nWARC-Target-URI: http://x\r\n\t/y\r\ncontent-length: 7", lambda: b"H\r\n\r\nab")
    assert row[:4] == ("response", "<a>", None, "http://x /y") and row[5] == 2 and row[7] == b"ab"


def test_large_files_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PARTITION", 20_000)
    noise = random.Random(1).randbytes
    records = [warc.record({"record_type": "response", "record_id": f"<urn:page:{i}>", "target_uri": "u", "refers_to": None, "payload_digest": "0" * 64, "payload_bytes": 0, "payload": noise(3000)}) for i in range(60)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:30]))
    (tmp_path / "b.warc").write_bytes(b"".join(records[30:]))
    reader = warc.WarcReader(str(tmp_path), True, True)
    parts = reader.partitions()
    assert len(parts) >= 9
    assert sorted(int(r[1][10:-1]) for p in parts for r in reader.read(p)) == list(range(60))
    out = tmp_path / "own"
    writer = warc.WarcWriter(str(out))
    columns = ["record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]
    batch = pa.RecordBatch.from_pylist([{"record_type": "response", "record_id": f"<urn:page:{i}>", "refers_to": None, "target_uri": "u", "payload_digest": "", "payload_bytes": 0, "payload": noise(3000)} for i in range(60)]).select(columns)
    writer.commit([writer.write(iter([batch]))])
    reader = warc.WarcReader(str(out), True)
    parts = reader.partitions()
    found = [int(r[1][10:-1]) for p in parts for r in reader.read(p) if r[1].startswith("<urn:page")]
    assert len(parts) >= 8 and sorted(found) == list(range(60))


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.pages_of(warc.read(spark, str(tmp_path / "w"))).collect() == []

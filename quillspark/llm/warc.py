"""WARC archives as a PySpark Python data source, and the write and read of pages."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from quillspark.llm.common import new_folder, table

SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Each write leaves a manifest of its own; together they say which files and pieces count.
MANIFEST = re.compile(r"_manifest-\w+\.json")
#: Payloads under this many bytes are stored again each time.
LEAST = 100
#: Bytes of archives that a read partition is meant to hold; bytes read at once.
PARTITION, BLOCK = 32 << 20, 1 << 16
#: What stands before the length of a member that this writer has made: gzip's head and the head of the field `sl`.
SYNC = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x04\xff" + struct.pack("<H2sH", 20, b"sl", 16)
#: Columns of SCHEMA with a header of their own.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _member(record: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its own and the record's length, so that readers can skip it."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    return SYNC + struct.pack("<QQ", len(SYNC) + 16 + len(body) + 8, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _head(fields: dict[str, str | None]) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode("utf-8", "surrogatepass")


def record(row: dict) -> bytes:
    """The bytes of one record. A response carries an HTTP head and the payload, a revisit the HTTP head only; its
    Content-Length is the whole payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"") if row["record_type"] == "response" else http
    fields = {HEADERS[k]: row[k] for k in ("record_type", "record_id", "target_uri", "refers_to")}
    fields |= {"WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha256:{row['payload_digest']}", "WARC-Profile": REVISIT if row["record_type"] == "revisit" else None}
    return _head(fields | {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}) + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    records: int
    cuts: list[int]


class WarcWriter(DataSourceArrowWriter):
    """One file a task under a name of its own. A manifest, written at the end, names the files of the attempts that
    count and where they can be cut, so that what a lost executor has left is never read. Each write has its own
    manifest, and a further write adds to those before; one that overwrites removes their manifests and files."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root)
        name, size, n, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            info = _member(_head({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields", "Content-Length": "0"}) + b"\r\n\r\n")
            out.write(info)
            size += len(info)
            for batch in iterator:
                for i in range(batch.num_rows):
                    data = _member(record({c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}))
                    if size - cuts[-1] >= PARTITION:
                        cuts.append(size)
                    out.write(data)
                    size, n = size + len(data), n + 1
        return Written(name, size, n, cuts)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        store.create_dir(root)
        old = _manifests(store, root) if self.overwrite else {}
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.name, m.size, m.records, m.cuts] for m in messages if m]).encode())
        for manifest, files in old.items():
            store.delete_file(f"{root}/{manifest}")
            for name, *_ in files:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")


def _manifests(store: fs.FileSystem, root: str) -> dict[str, list]:
    """The manifests of a folder by name: (file, size, records, cuts) each."""
    out = {}
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if MANIFEST.fullmatch(f.base_name):
            with store.open_input_stream(f.path) as x:
                out[f.base_name] = json.loads(x.read())
    return out


@dataclass
class Pieces(InputPartition):
    """(file, first byte, byte after the last): records that begin there."""

    of: tuple[tuple[str, int, int], ...]


class WarcReader(DataSourceReader):
    """Partitions are pieces of files of about PARTITION bytes, small files together. Files that this writer has made are cut
    where its manifests say, others only with `split`: then a task looks for the next record from its first byte on, and
    a payload that itself holds an uncompressible archive could be taken for records. Equality and IN filters on columns
    that are headers are decided on the header; then the payload of an unwanted record is neither inflated nor copied."""

    def __init__(self, path: str, payload: bool, split: bool = False):
        self.path, self.payload, self.split, self.wanted = path, payload, split, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _store(self.path)
        found = [(name, size, cuts) for files in _manifests(store, root).values() for name, size, _, cuts in files]
        if not found:
            foreign = [(f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(root)) if re.search(r"\.warc(\.gz)?$", f.base_name)]
            found = [(name, size, list(range(0, max(1, size), PARTITION)) if self.split else [0]) for name, size in foreign]
        pieces = [(name, a, b) for name, size, cuts in sorted(found) for a, b in zip(cuts, [*cuts[1:], size])]
        parts, size = [[]], 0
        for piece in pieces:
            if parts[-1] and size + piece[2] - piece[1] > PARTITION:
                parts.append([])
                size = 0
            parts[-1].append(piece)
            size += piece[2] - piece[1]
        return [Pieces(tuple(p)) for p in parts]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        store, root = _store(self.path)
        for name, start, end in partition.of:
            with store.open_input_file(f"{root}/{name}") as file:
                gz = name.endswith(".gz")
                at = _next_record(file, start, gz) if self.split and start else start
                yield from (_members if gz else _plain)(file, self._row, at, end)

    def _row(self, head: bytes, rest) -> tuple | None:
        """head: up to the blank line. rest(): the record's other bytes, called only for records that are wanted."""
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "surrogatepass")).split("\r\n")[1:]
        headers = {name.strip(): v.strip() for name, colon, v in (line.partition(":") for line in lines) if colon}
        plain = {name.lower(): v for name, v in headers.items()}  # names of headers have no case
        value = {c: plain.get(h.lower()) for c, h in HEADERS.items()}
        value["payload_digest"] = (value["payload_digest"] or "").removeprefix("sha256:") or None
        if any(value[c] not in want for c, want in self.wanted.items()):
            return None
        payload = size = None
        if value["record_type"] in ("response", "revisit") and self.payload:
            block = rest()[: int(plain["content-length"])]
            http, _, body = block.partition(b"\r\n\r\n")
            m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
            payload = body if value["record_type"] == "response" else None
            size = len(body) if payload is not None else int(m[1]) if m else None
        return (*(value[c] for c in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest")), size, headers, payload)


def _next_record(file, at: int, gz: bool) -> int:
    """The first byte from `at` on at which a record begins, or the file's size."""
    mark, end = (b"\x1f\x8b\x08" if gz else b"\r\n\r\nWARC/1."), file.size()
    while at < end:
        file.seek(at)
        data = file.read(1 << 20)
        for m in re.finditer(re.escape(mark), data):
            if not gz:
                return at + m.start() + 4
            file.seek(at + m.start())
            try:
                if zlib.decompressobj(31).decompress(file.read(BLOCK), 7) == b"WARC/1.":
                    return at + m.start()
            except zlib.error:
                pass
        at += max(1, len(data) - len(mark) + 1) if len(data) == 1 << 20 else len(data)
    return end


def _members(file, row, at: int, end: int) -> Iterator[tuple]:
    """Records of a file of gzip members that begin from `at` to `end`. Members with an `sl` field are skipped by
    seeking, others by inflating."""
    while at < end:
        file.seek(at)
        data = file.read(BLOCK)
        length = struct.unpack_from("<Q", data, 16)[0] if data[3:4] == b"\x04" and data[12:14] == b"sl" else None
        inflate = zlib.decompressobj(31)
        got, fed = inflate.decompress(data, 4096), len(data)
        while b"\r\n\r\n" not in got and not inflate.eof:
            more = inflate.unconsumed_tail or file.read(BLOCK)
            fed += 0 if inflate.unconsumed_tail else len(more)
            got += inflate.decompress(more, 4096)
        head, _, begun = got.partition(b"\r\n\r\n")
        state = {"fed": fed}

        def rest(inflate=inflate, begun=begun, state=state) -> bytes:
            parts = [begun]
            while not inflate.eof:
                more = inflate.unconsumed_tail
                if not more:
                    more = file.read(BLOCK)
                    state["fed"] += len(more)
                parts.append(inflate.decompress(more))
            return b"".join(parts)

        found = row(head, rest)
        if length is None:
            rest()
            length = state["fed"] - len(inflate.unused_data)
        at += length
        if found:
            yield found


def _plain(file, row, at: int, stop: int) -> Iterator[tuple]:
    """Records of an uncompressed file that begin from `at` to `stop`; Content-Length says where the next one begins."""
    end = file.size()
    while at < stop:
        file.seek(at)
        got = file.read(4096)
        while b"\r\n\r\n" not in got and at + len(got) < end:
            got += file.read(4096)
        head, _, _ = got.partition(b"\r\n\r\n")
        n = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
        start = at + len(head) + 4

        def rest(start=start, n=n) -> bytes:
            file.seek(start)
            return file.read(n)

        found = row(head, rest)
        at = start + n + 4
        if found:
            yield found


class WarcSource(DataSource):
    """format("warc"): option path; payload=false leaves payload and payload_bytes null and reads headers only; split=true
    cuts foreign files too (see WarcReader). Appending adds archives, overwriting replaces those that manifests name."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", self.options.get("split", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) to the records to write. Of pages with equal payloads of LEAST bytes or more, that with
    the smallest page_id is the response; the others revisit it. Only digests are grouped; html moves once, by
    page_id, so equal pages do not meet in one task. Rows that repeat page_id and payload have the same type. A
    null page_id revisits, but is never referred to; a null html is an empty payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).select("*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    light = p.where(F.col("payload_bytes") >= LEAST).select("page_id", "payload_digest")
    first = light.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    again = light.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct().alias("r")
    out = p.alias("p").join(again, F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.payload_digest") == F.col("r.payload_digest")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    new = F.col("first").isNull()
    return out.select(
        F.when(new, "response").otherwise("revisit").alias("record_type"),
        urn("p.page_id").alias("record_id"),
        F.when(~new, urn("first")).alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.col("p.payload_digest").alias("payload_digest"),
        "payload_bytes",
        F.when(new, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Archives pages; with mode append beside what the folder holds, with overwrite in its place. Pages of one write
    revisit each other only."""
    register(pages.sparkSession)
    archived(pages).write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, payload: bool = True, split: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).option("split", str(split)).load(path)


def pages_of(records: DataFrame) -> DataFrame:
    """What the archives say of each page: of a response's payload its own bytes and SHA-256, of a revisit what it states."""
    r = records.where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    return r.select(page("record_id").alias("page_id"), "payload_bytes", F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return pages_of(read(spark, path))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

"""WARC archives as a chunked record table.

A record is rows of (record_id, chunk_no, data); no step joins the chunks of a record.
Writing sorts each task's chunks by record and streams them into compressed archive
files, one member per record, with the digests that an earlier stream over the same
chunks carried from chunk to chunk. Reading streams the files piece by piece and gives
chunk rows back with the digest so far; the last chunk of a record has the digest of
the whole payload, which must equal the one in its header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_batches, hot_join, need, written
from plumbline.plans.lookup import scratch_path
from plumbline.plans.workers import ship

ship(__name__)
CHUNK_BYTES = 1 << 18
FILE_BYTES = 1 << 28
CHUNKS = "record_id string, copy bigint, chunk_no bigint, last boolean, data binary"
KEYS = ("record_id", "copy")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BREAK = b"\r\n"


# --- chunk tables --------------------------------------------------------------------

def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Payloads of (record_id, copy, payload) as chunk rows; ``copy`` tells rows of one
    record_id apart. A null or empty payload is one empty chunk."""
    arrow_batches(rows.sparkSession)
    rows = need(rows, "record_id", "copy", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies, payload = (b.column(i) for i in range(3))
            for i in range(b.num_rows):
                data = memoryview(payload[i].as_buffer() if payload[i].is_valid else b"")
                cuts = range(0, max(len(data), 1), chunk_bytes)
                for n, c in enumerate(cuts):
                    yield pa.RecordBatch.from_pydict({
                        "record_id": [ids[i].as_py()], "copy": [copies[i].as_py()], "chunk_no": [n],
                        "last": [n == len(cuts) - 1], "data": [bytes(data[c:c + chunk_bytes])]},
                        _CHUNK_SCHEMA)

    return rows.mapInArrow(run, CHUNKS)


_CHUNK_SCHEMA = pa.schema([("record_id", pa.string()), ("copy", pa.int64()), ("chunk_no", pa.int64()),
                           ("last", pa.bool_()), ("data", pa.binary())])


def bare_digest(sha) -> str:
    return base64.b32encode(sha.digest()).decode("ascii")


def digests(chunks: DataFrame) -> DataFrame:
    """(record_id, copy, bytes, digest) of each record, its state carried from chunk to
    chunk of a sorted stream."""
    dealt = chunks.repartition(*KEYS).sortWithinPartitions(*KEYS, "chunk_no")
    schema = pa.schema([("record_id", pa.string()), ("copy", pa.int64()), ("bytes", pa.int64()),
                        ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(), 0
        for b in batches:
            out = {n: [] for n in schema.names}
            for i in range(b.num_rows):
                data = b.column("data")[i].as_buffer()
                sha.update(data)
                size += len(data)
                if b.column("last")[i].as_py():
                    for n, v in zip(out, (*(b.column(k)[i].as_py() for k in KEYS), size,
                                          bare_digest(sha)), strict=True):
                        out[n].append(v)
                    sha, size = hashlib.sha1(), 0
            yield pa.RecordBatch.from_pydict(out, schema)

    return dealt.mapInArrow(run, "record_id string, copy bigint, bytes bigint, digest string")


# --- writing -------------------------------------------------------------------------

def header(kind: str, record_id: str, length: int, **fields: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>",
             *[f"{n.replace('_', '-')}: {v}" for n, v in fields.items()], f"Content-Length: {length}"]
    return "".join(f"{x}\r\n" for x in lines).encode("utf-8") + BREAK


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(folder)


def write_archives(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Stream chunk rows with (bytes, digest, refers_to, uri) into archives in ``folder``.

    Returns the stored list of files (path, records). A revisit carries no payload. A
    task that runs again writes files of new names; only those it reports are read.
    """
    arrow_batches(chunks.sparkSession)
    dealt = chunks.repartition(*KEYS).sortWithinPartitions(*KEYS, "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out = packer = path = None
        records = 0

        def close():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records]})

        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names if n != "data"}
                if row["chunk_no"] == 0:
                    if out is not None and out.tell() > file_bytes:
                        yield close()
                        out = None
                    if out is None:
                        path, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(row)))
                    records += 1
                if row["refers_to"] is None:
                    out.write(packer.compress(b.column("data")[i].as_buffer()))
                if row["last"]:
                    out.write(packer.compress(BREAK + BREAK) + packer.flush())
        if out is not None:
            yield close()

    return written(dealt.mapInArrow(run, "path string, records bigint"), "archive_files")


def _head(row: dict) -> bytes:
    fields = {"WARC_Target_URI": row["uri"]} if row["uri"] else {}
    fields["WARC_Payload_Digest"] = f"sha1:{row['digest']}"
    if row["refers_to"] is None:
        return header("response", row["record_id"], len(HTTP) + row["bytes"], **fields,
                      Content_Type="application/http;msgtype=response") + HTTP
    fields |= {"WARC_Refers_To": f"<{row['refers_to']}>",
               "WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
               "X_Payload_Bytes": str(row["bytes"])}
    return header("revisit", row["record_id"], 0, **fields)


# --- reading -------------------------------------------------------------------------

class Reader:
    """Records of one archive, read and decompressed piece by piece."""

    def __init__(self, stream, piece: int = CHUNK_BYTES):
        self.stream, self.piece = stream, piece
        self.raw, self.plain, self.unpack = b"", b"", zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompress at most one more piece; False at the end of the archive."""
        while True:
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    return False
            got = self.unpack.decompress(self.raw, self.piece)
            self.raw = b"" if self.unpack.eof else self.unpack.unconsumed_tail
            if got:
                self.plain += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.plain:
            if not self.more():
                return None
        found, self.plain = self.plain.split(mark, 1)
        return found

    def body(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.plain and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.plain = self.plain[:length], self.plain[length:]
            length -= len(part)
            yield part

    def records(self) -> Iterator[tuple[dict, Iterator[bytes]]]:
        """(header fields, payload pieces); the pieces must be used up in turn."""
        while (head := self.until(BREAK + BREAK)) is not None:
            lines = head.decode("utf-8").split("\r\n")
            if lines[0].strip() not in ("WARC/1.0", "WARC/1.1"):
                raise ValueError(f"not a WARC record: {lines[0][:40]}")
            fields = {n.lower(): v.strip() for n, v in (x.split(":", 1) for x in lines[1:])}
            length = int(fields["content-length"])
            if "application/http" in fields.get("content-type", ""):
                before = self.until(BREAK + BREAK)
                length -= len(before) + 4
            yield fields, self.body(length)
            if self.until(BREAK + BREAK) is None:
                raise ValueError("the archive ends inside a record")


RECORDS = ("record_id string, record_type string, refers_to string, uri string, header_digest string, "
           "header_bytes bigint, chunk_no bigint, last boolean, bytes_so_far bigint, digest_so_far string, "
           "data binary")


def read_archives(files: DataFrame, folder: str, keep_data: bool = True) -> DataFrame:
    """Chunk rows of all records of the listed archives, each with the digest so far.

    Raises if the payload of a response has not the digest of its header.
    """
    spark = files.sparkSession
    files = files.select("path").repartition(max(1, files.count()), "path")
    schema = pa.schema([(n, {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
                         .get(t, pa.string())) for n, t in (x.split() for x in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    yield from _batched(_chunk_rows(Reader(stream), keep_data), schema)

    arrow_batches(spark)
    return files.mapInArrow(run, RECORDS)


def _chunk_rows(reader: Reader, keep_data: bool) -> Iterator[tuple]:
    for fields, body in reader.records():
        def name(field: str, fields: dict = fields) -> str | None:
            value = fields.get(field)
            return value.strip("<>") if value is not None else None

        sha, size, no = hashlib.sha1(), 0, 0
        digest = (name("warc-payload-digest") or "").removeprefix("sha1:") or None
        stated = name("x-payload-bytes")
        fixed = (name("warc-record-id"), name("warc-type"), name("warc-refers-to"),
                 name("warc-target-uri"), digest, int(stated) if stated is not None else None)
        held = b""
        for part in body:
            if held:
                sha.update(held)
                size += len(held)
                yield (*fixed, no, False, size, bare_digest(sha.copy()), held if keep_data else None)
                no += 1
            held = part
        sha.update(held)
        size += len(held)
        if fixed[1] == "response" and digest != bare_digest(sha):
            raise ValueError(f"the payload of {fixed[0]} has not the digest of its header")
        yield (*fixed, no, True, size, bare_digest(sha), held if keep_data else None)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 500, data: int = -1) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[data] or b"")
        if len(held) >= most or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in
                                              zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in
                                          zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


# --- pages ---------------------------------------------------------------------------

def page_record(page_id: str):
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("none")))


def map_rows(records: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunk rows of pages with what their headers need; bytes and sha1 are known."""
    schema = pa.schema([*_CHUNK_SCHEMA, ("bytes", pa.int64()), ("digest", pa.string()),
                        ("refers_to", pa.string()), ("uri", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batched(_page_chunks(b, chunk_bytes), schema, data=4)

    return records.select("record_id", "copy", "bytes", "sha1", "refers_to", "uri", "html").mapInArrow(
        run, CHUNKS + ", bytes bigint, digest string, refers_to string, uri string")


def _page_chunks(b: pa.RecordBatch, chunk_bytes: int) -> Iterator[tuple]:
    for i in range(b.num_rows):
        record, copy, size, sha, refers, uri = (b.column(c)[i].as_py() for c in range(6))
        html = b.column(6)[i]
        data = memoryview(html.as_buffer() if html.is_valid else b"")
        digest = base64.b32encode(bytes.fromhex(sha)).decode("ascii")
        cuts = range(0, max(len(data), 1), chunk_bytes)
        for n, c in enumerate(cuts):
            yield (record, copy, n, n == len(cuts) - 1, bytes(data[c:c + chunk_bytes]), size, digest,
                   refers, uri)


def archive_pages(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
                  file_bytes: int = FILE_BYTES, folder: str | None = None) -> DataFrame:
    """Write a record per page and read all back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to) per page.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the
    largest page_id is the response and the others revisit it. Null html is an empty
    payload. Rows without page_id are responses that nothing refers to; several rows
    of that largest page_id are all responses. Digest and size of a revisit are those
    its header states; they are the response's.
    """
    spark = arrow_batches(pages.sparkSession)
    folder = folder or scratch_path(spark, "archives")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = need(pages, "page_id", "url", "html").select(
        "page_id", "url", "html", F.monotonically_increasing_id().alias("copy"),
        F.octet_length(html).cast("bigint").alias("bytes"), F.sha1(html.cast("binary")).alias("sha1"))
    shared = (rows.where(F.col("page_id").isNotNull() & (F.col("bytes") >= min_bytes)).groupBy("sha1")
              .agg(F.max("page_id").alias("top"), F.count("*").alias("n")))
    shared = written(shared.where("n > 1"), "shared_payloads")
    known = hot_join(rows, shared, "sha1", "n")
    revisits = (F.col("bytes") >= min_bytes) & (F.col("page_id") < F.col("top"))
    records = known.select(
        page_record("page_id").alias("record_id"), "copy", "bytes", "sha1", F.col("url").alias("uri"),
        F.when(revisits, page_record("top")).alias("refers_to"),
        F.when(~F.coalesce(revisits, F.lit(False)), F.col("html")).alias("html"))
    files = write_archives(map_rows(records, chunk_bytes), folder, file_bytes)
    back = read_archives(files, folder, keep_data=False).where("last")
    page = F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1)
    refers = F.regexp_extract("refers_to", r"^urn:page:(-?\d+)$", 1)
    is_response = F.col("record_type") == "response"
    return back.select(
        F.when(page != "", page).cast("bigint").alias("page_id"),
        F.when(is_response, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(is_response, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type", F.when(refers != "", refers).cast("bigint").alias("refers_to"))

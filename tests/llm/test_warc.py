import base64
import gzip
import hashlib
import io

from pyspark.sql import functions as F

from plumbline.llm import warc

SCHEMA = "page_id bigint, url string, html string, copy string, bytes string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_pages_come_back_with_revisits(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "http://b/", "<p>é</p>"),
            (3, "http://c/", None), (4, "http://d/", ""), (5, "http://e/", "x\r\n\r\nWARC/1.1\r\n" * 5000),
            (None, "http://f/", "<p>é</p>"), (None, None, None), (6, "u", "only"), (6, "u", "only")]
    got = warc.archive_pages(pages(spark, rows), chunk_bytes=1000, file_bytes=200,
                             folder=str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((h or "").encode()), digest(h),
                   "revisit" if refer else "response", refer) for i, _, h, refer in [
        (*rows[0], 9), (*rows[1], 9), (*rows[2], None), (*rows[3], 4), *[(*r, None) for r in rows[4:]]])
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in got) == want
    # Plain gzip members of standard records.
    text = b"".join(gzip.open(io.BytesIO(p.read_bytes())).read() for p in (tmp_path / "w").iterdir())
    assert text.count(b"WARC-Type: response\r\n") == 7 and text.count(b"WARC-Type: revisit\r\n") == 3
    assert b"WARC-Refers-To: <urn:page:9>" in text


def test_a_size_limit_leaves_small_payloads_alone(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = warc.archive_pages(pages(spark, rows), min_bytes=4).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 4, 4: None}
    assert not warc.archive_pages(pages(spark, [])).collect()


def test_oversized_records_stay_in_chunks(spark, tmp_path):
    """A chunk table is written and read without a row of a whole record."""
    size, n = 5000, 37
    body = {r: bytes((i * 7 + len(r)) % 251 for i in range(size * n + 13)) for r in ("a", "bb")}
    chunks = spark.createDataFrame(
        [(r, 0, i, i == n, body[r][i * size:(i + 1) * size]) for r in body for i in range(n + 1)],
        warc.CHUNKS).repartition(5)
    known = warc.digests(chunks)
    assert {r.record_id: (r.bytes, r.digest) for r in known.collect()} == {
        r: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for r, b in body.items()}
    full = chunks.join(known, ["record_id", "copy"]).withColumns(
        {"refers_to": F.lit(None).cast("string"), "uri": F.lit("http://x/")})
    files = warc.write_archives(full, str(tmp_path / "w"))
    back = warc.read_archives(files, str(tmp_path / "w")).collect()
    for r, b in body.items():
        mine = sorted((x for x in back if x.record_id == r), key=lambda x: x.chunk_no)
        assert b"".join(x.data for x in mine) == b
        assert [x.last for x in mine] == [False] * (len(mine) - 1) + [True]
        sha, at = hashlib.sha1(), 0
        for x in mine:
            sha.update(x.data)
            at += len(x.data)
            assert (x.bytes_so_far, x.digest_so_far) == (at, warc.bare_digest(sha.copy()))


def test_reading_works_at_any_piece_size():
    body = b"payload\r\n\r\n" * 50
    record = (warc.header("response", "urn:x:1", len(warc.HTTP) + len(body),
                          Content_Type="application/http;msgtype=response") + warc.HTTP + body + b"\r\n\r\n")
    data = gzip.compress(record) + gzip.compress(record.replace(b"urn:x:1", b"urn:x:2"))
    for piece in (1, 7, 64, 100_000):
        got = [(f["warc-record-id"], b"".join(p)) for f, p in
               warc.Reader(io.BytesIO(data), piece).records()]
        assert got == [("<urn:x:1>", body), ("<urn:x:2>", body)]

import hashlib

import pytest

from ledgerwalk.llm import warc
from ledgerwalk.llm.common import scratch

BIG = "<p>" + "x" * 200
SCHEMA = "page_id bigint, url string, html string, digest string, payload string, header int"
ROWS = [(5, "http://e", BIG), (3, "http://c\r\nX: y", BIG), (9, None, BIG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
        (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "é" * 49 + "a"), (11, "u", "é" * 49 + "a"), (None, "n", BIG), (12, "u", "z" * 300_000),
        (3, "again", BIG), (None, None, "<i>" * 90), (13, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch(spark, "t")
    warc.write_archive(spark.createDataFrame([(*r, "clash", "clash", 1) for r in ROWS], SCHEMA), path)
    return path


def test_records(spark, archive):
    want = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        first = min((p for p, _, h in ROWS if (h or "") == (html or "") and p is not None), default=None)
        again = len(data) >= 100 and page != first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    got = [tuple(r) for r in warc.read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_round_trip_of_record_bytes(spark, archive):
    for r in warc.read_archive(spark, archive).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = rest[:int(fields[b"Content-Length"])]
        assert rest[len(block):] == b"\r\n\r\n" and b"\n" not in fields[b"WARC-Target-URI"]
        http, _, body = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        assert body == (bytes(r["payload"]) if r["record_type"] == "response" else b"")
    assert spark.read.parquet(f"{archive}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_damaged_payload_stops_the_read(spark, archive):
    path = scratch(spark, "damaged")
    p = spark.read.parquet(f"{archive}/payloads")
    p.selectExpr("digest", "cast(concat(cast(payload as string), '!') as binary) payload", "first_id", "n_bytes").write.parquet(f"{path}/payloads")
    spark.read.parquet(f"{archive}/records").write.parquet(f"{path}/records")
    with pytest.raises(Exception, match="does not match its address"):
        warc.read_archive(spark, path).collect()


def test_empty(spark):
    path = scratch(spark, "empty")
    warc.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archive(spark, path).count() == 0

import base64
import hashlib

import pytest

from liveness.llm import warc as W

from .cases import clashing, rows

PAGES = "page_id long, url string, html string"
ROWS = [(5, "http://a/5", "<p>same</p>"), (2, "http://a/2 x\r\ny", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a/1", None),
        (3, "http://a/3", ""), (4, "http://a/4", "Ünï\r\n\r\ncode \U0001f600"), (None, "http://a/n", "<p>no id</p>"),
        (7, "http://a/7", "x" * 200_000), (2, "http://a/2", "<p>same</p>"), (8, "u", "<p>again</p>"), (8, "u", "other"), (6, "u", "other"),
        (None, None, "<p>same</p>")]


def brute(data, least=0):
    first = {}
    for k, (i, _, h) in enumerate(data):
        p = (h or "").encode()
        first[p] = min(first.get(p, (True, 0, k)), (i is None, i or 0, k))
    out = []
    for k, (i, _, h) in enumerate(data):
        p = (h or "").encode()
        response = len(p) < least or first[p][2] == k
        refers = None if response or first[p][0] else first[p][1]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 11, 1000])
def test_round_trip(spark, least):
    got = W.round_trip(clashing(spark.createDataFrame(ROWS, PAGES)).coalesce(1), least=least)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute(ROWS, least)


def test_payloads_are_stored_once_and_records_rebuilt(spark, tmp_path):
    path = str(tmp_path / "archive")
    W.write_archive(spark.createDataFrame(ROWS, PAGES), path)
    stored = [bytes(r.payload) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in ROWS})
    for r in W.records(spark, path).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and body.endswith(b"\r\n\r\n")
        assert r.digest is None or hashlib.sha256(body[:-4]).digest() == bytes(r.digest)


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "archive")
    W.write_archive(spark.createDataFrame([(1, "u", "abc")], PAGES), path)
    broken = spark.createDataFrame([(bytearray(hashlib.sha256(b"abc").digest()), bytearray(b"abd"))], "digest binary, payload binary")
    broken.write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload is not the one digested"):
        W.read_archive(spark, path).collect()


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], PAGES)).count() == 0

"""Round trips through archives, and the choice of responses."""

import base64
import hashlib

from pyspark.sql import functions as F

from saleslens.llm import warc
from saleslens.llm.common import new_path


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def round_trip(spark, df, **kw):
    path = new_path(spark, "warc-test")
    warc.write(df, path, **kw)
    return warc.resolve(warc.read(spark, path)), path


def test_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    pages = [(3, "http://a/1", "same"), (1, None, "same"), (2, "http://b\r\nX: y", "same"), (4, "", tricky), (5, "http://é/ü", "é" * 100_000), (6, "u", None), (7, "u", ""), (None, "http://n", "same"), (8, "q", "lone"), (8, "r", "lone")]
    got, path = round_trip(spark, spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, refers_to int"))
    rows = got.collect()
    want = sorted(((p, (t or "").encode()) for p, _, t in pages), key=repr)
    assert sorted(((r.page_id, bytes(r.payload)) for r in rows), key=repr) == want
    assert all(r.digest == b32(bytes(r.payload)) and r.payload_bytes == len(r.payload) for r in rows)
    first = {}
    for p, body in want:
        if p is not None:
            first[body] = min(p, first.get(body, p))
    for r in rows:
        revisit = r.page_id is not None and first[bytes(r.payload)] != r.page_id
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (first[bytes(r.payload)] if revisit else None)
    stored = warc.read(spark, path).where("record_type = 'revisit'")
    assert stored.count() == 3 and stored.where(F.col("payload").isNotNull()).count() == 0


def test_small_payloads_stay_responses_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got, _ = round_trip(spark, df, min_bytes=5)
    assert {(r.page_id, r.refers_to) for r in got.collect()} == {(1, None), (2, None), (3, None), (4, 3)}
    empty, _ = round_trip(spark, df.limit(0))
    assert empty.count() == 0


def test_one_pair_of_id_and_payload_may_hold_most_rows(spark):
    """Null ids with one payload, and a repeated response: dealt out over several files, every record with an id of its own."""
    rows = [(None, f"http://h/{i % 7}", "x" * 500) for i in range(4000)] + [(1, "http://one", "y" * 800)] * 3000 + [(i, "http://two", "y" * 800) for i in range(2, 500)]
    got, path = round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), file_bytes=1 << 20)
    stored = warc.read(spark, path)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").count() >= 6
    ids = [r.record_id for r in stored.select("record_id").collect()]
    assert len(ids) == len(set(ids)) == len(rows)
    counts = {(r.record_type, r.refers_to): r["count"] for r in got.groupBy("record_type", "refers_to").count().collect()}
    assert counts == {("response", None): 7000, ("revisit", 1): 498}
    assert got.where("payload is null").count() == 0

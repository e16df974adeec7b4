import base64
import hashlib
import io
import re
from datetime import datetime

import pytest
import zstandard
from pyspark.sql import functions as F

from matchloom.llm import warc
from matchloom.llm.common import shared_dir

ROWS = [
    (1, "http://a", "<p>same</p>"), (2, "http://b\r\nX: y", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\U0001f642\r\n\r\nWARC/1.1"), (None, "u", "<p>same</p>"),
    (None, "v", "alone"), (6, "w", "twin"), (6, "w", "twin"), (7, "big", "z" * 700_000),
]


def expect(rows):
    last: dict = {}
    for p, _, h in rows:
        h = (h or "").encode()
        last[h] = max((x for x in (last.get(h), p) if x is not None), default=None)
    for p, _, h in rows:
        h = (h or "").encode()
        revisit = last[h] is not None and p != last[h]
        yield p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", last[h] if revisit else None


def files(table):
    """Each bundle as the one file it stands for."""
    out = {}
    for r in sorted(table.collect(), key=lambda r: (r.bundle_id, r.frame)):
        out[r.bundle_id] = out.get(r.bundle_id, b"") + bytes(r.data)
    return out


def plain_reader(raw):
    """(headers, block) of each record of an uncompressed WARC file, by the letter of the format."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        assert len(head) == len(lines)
        at = end + 4 + int(head["content-length"]) + 4
        assert raw[at - 4 : at] == b"\r\n\r\n"
        yield head, raw[end + 4 : at - 4]


@pytest.mark.parametrize("limit", [warc.BROADCAST_BYTES, -1])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3).withColumn("bundle", F.lit(1))
    table = warc.write_bundles(pages, shared_dir(spark), datetime(2024, 5, 6, 7, 8, 9))
    got = warc.read_records(table).collect()
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted(expect(ROWS), key=repr)
    assert {r.payload.decode() for r in got if r.page_id == 5} == {ROWS[4][2]}
    assert {r.target for r in got if r.page_id == 2} == {"http://b%0D%0AX:%20y"} and {r.target for r in got if r.page_id == 3} == {"urn:page:3"}


def test_files_are_valid_warc(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    table = warc.write_bundles(pages, shared_dir(spark), datetime(2024, 5, 6, 7, 8, 9))
    records = []
    for data in files(table).values():
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        records += plain_reader(raw)
        # the footer alone tells where the frames are
        assert b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + c], max_output_size=d) for a, c, d in warc.read_seek_table(data)) == raw
    assert len(records) == len(ROWS)
    ids = [h["warc-record-id"] for h, _ in records]
    assert len(set(ids)) == len(ids) and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", i) for i in ids)
    by_id = {h["warc-record-id"]: (h, b) for h, b in records}
    for head, block in records:
        assert head["warc-date"] == "2024-05-06T07:08:09Z" and head["content-type"] == "application/http; msgtype=response"
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        if head["warc-type"] == "response":
            assert head["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert f"Content-Length: {len(payload)}".encode() in http
        else:
            other, _ = by_id[head["warc-refers-to"]]
            assert not payload and other["warc-type"] == "response" and other["warc-payload-digest"] == head["warc-payload-digest"]
            assert (head["warc-refers-to-target-uri"], head["warc-refers-to-date"]) == (other["warc-target-uri"], other["warc-date"])


def test_fetch_opens_single_frames(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " + "x" * 50_000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    table = warc.write_bundles(pages, shared_dir(spark))
    where = {r.page_id: r for r in warc.identifiers(table).collect()}
    assert max(r.frame for r in where.values()) > 3
    asked = spark.createDataFrame([(where[3].record_id,), (where[39].record_id,), ("<urn:uuid:none>",)], "record_id string")
    got = {r.record_id: warc.parse(bytes(r.record))[2][:8].strip() for r in warc.fetch(table, asked).collect()}
    assert got == {where[3].record_id: b"page 3 x", where[39].record_id: b"page 39"}
    plan = warc.fetch(table, asked)._jdf.queryExecution().executedPlan().toString()
    assert "In(bundle_id" in plan.replace("EqualTo(bundle_id", "In(bundle_id") and "In(frame, [" in plan  # handed to the scan of the data
    monkeypatch.setattr(warc, "MOST_PLACES", 1)
    assert {r.record_id for r in warc.fetch(table, asked).collect()} == set(got)
    one = warc.read_records(table, warc.identifiers(table).where("page_id = 7"))
    assert [(r.page_id, bytes(r.payload[:7])) for r in one.collect()] == [(7, b"page 7 ")]


def test_empty_table_and_query(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_bundles(none, shared_dir(spark))).count() == 0
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op7_warc(spark, sf).collect())) == sorted(expect(rows))

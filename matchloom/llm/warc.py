"""WARC/1.1 archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of frames closed by a seek table in a skippable
frame, so any standard decoder reads it through and a seeking reader opens one frame. Bundles are stored frame by frame
as rows of a Parquet table, so every file system Spark writes to can hold them and a reader fetches the frames it asks
for; the ``data`` of a bundle's rows, in order, is a complete .warc.zst file. Each row lists its frame's records: their
identifiers, the page and the record they stand for, and where they lie in the frame. This is the identifier map; reads
go through it.

A response holds the page as an HTTP message. A row whose payload a response holds becomes a revisit: the HTTP head
without the payload, the payload's digest, and the response's record identifier, target and date. Responses are written
first, so that revisits can name them. Digests of payloads that occur twice or more are broadcast while their measured
size is within ``BROADCAST_BYTES``; beyond that, pages are joined with them by a shuffle that deals a hot payload to
several tasks.

Defined results: a null html is an empty payload; a null url gives the target ``urn:page:`` and the page_id; white space
and control characters in a url are percent-encoded. Of equal payloads, every row with the largest page_id is a response
and the others revisit it; a null page_id counts as smaller than any other, and payloads of null page_ids alone are all
responses. Repeated rows give repeated records with identifiers of their own. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, map_batches, read_table, replicated, shared_dir, spread

#: A frame closes at this many bytes of records, a bundle at this many compressed bytes.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: The measured bytes of shared digests up to which they are broadcast; one takes about DIGEST_BYTES.
BROADCAST_BYTES, DIGEST_BYTES = 64 << 20, 100
#: The most frames of a request that the scan itself looks up.
MOST_PLACES = 2000
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = "record_id:string,page_id:long,target:string,sha1:binary,payload_bytes:long,refers_id:string,refers_to:long,offset:long,length:long"
TABLE = f"bundle_id string, frame int, data binary, index array<struct<{_ENTRY}>>"
_ARROW_ENTRY = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("target", pa.string()), ("sha1", pa.binary()), ("payload_bytes", pa.int64()), ("refers_id", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_ARROW = pa.schema([("bundle_id", pa.string()), ("frame", pa.int32()), ("data", pa.binary()), ("index", pa.list_(_ARROW_ENTRY))])


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def digest(payload: bytes) -> str:
    return base32(hashlib.sha1(payload).digest())


def target_uri(page_id: int | None, url: str | None) -> str:
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record(record_id: str, date: str, target: str, told: str, n: int, payload: bytes | None, refers: tuple[str, str, str] | None = None) -> bytes:
    """One record: a response with its ``payload``, or a revisit of ``refers`` (record id, target, date)."""
    block = http_head(n) + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{told}"]
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers[0]}", f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {refers[2]}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP head and payload of one record."""
    end = raw.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, http, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer alone."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, c, d))
        at += c
    return out


def _pack(rows: DataFrame, made: str, prefix: str) -> DataFrame:
    """Frames of ``rows`` (page_id, url, d, n, payload, refers_id, refers_target, refers_to), each bundle closed by its seek table."""
    namespace = uuid.uuid4()

    def pack(batches):
        squeeze, part, serial, count = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0, 0
        raw, size, index, sizes = [], 0, [], []

        def row(data, entries):
            return pa.RecordBatch.from_pydict({"bundle_id": [f"{prefix}-{part:06d}-{serial:06d}"], "frame": [len(sizes)], "data": [data], "index": [entries]}, schema=_ARROW)

        def frame():
            nonlocal raw, size, index
            block = squeeze.compress(b"".join(raw))
            out = row(block, index)
            sizes.append((len(block), size))
            raw, size, index = [], 0, []
            return out

        for b in batches:
            for page_id, url, sha1, n, payload, refers_id, refers_target, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                # a retried task gives its records the same identifiers
                name = f"<urn:uuid:{uuid.uuid5(namespace, f'{part}/{count}')}>"
                count += 1
                target = target_uri(page_id, url)
                refers = None if refers_id is None else (refers_id, refers_target, made)
                r = record(name, made, target, base32(sha1), n, None if payload is None else payload.encode(), refers)
                index.append({"record_id": name, "page_id": page_id, "target": target, "sha1": sha1, "payload_bytes": n, "refers_id": refers_id, "refers_to": refers_to, "offset": size, "length": len(r)})
                raw.append(r)
                size += len(r)
                if size >= FRAME_BYTES:
                    yield frame()
                    if sum(c for c, _ in sizes) >= BUNDLE_BYTES:
                        yield row(seek_table(sizes), [])
                        serial, sizes = serial + 1, []
        if raw:
            yield frame()
        if sizes:
            yield row(seek_table(sizes), [])

    return map_batches(rows, pack, TABLE)


def _digests(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html)).alias("d"), F.octet_length(html).cast("long").alias("n"))


def write_bundles(pages: DataFrame, path: str, made: datetime | None = None) -> DataFrame:
    """Write a record dated ``made`` (now) for every row of ``pages`` under ``path``; returns the table of frames."""
    spark, date = pages.sparkSession, (made or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    keyed = _digests(pages)
    shared = cut(keyed.groupBy("d", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1 and last is not null").drop("copies"))
    if shared.count() * DIGEST_BYTES <= BROADCAST_BYTES:
        marked = keyed.join(F.broadcast(shared), ["d", "n"], "left")
    else:
        marked = keyed.withColumn("part", spread("page_id")).join(replicated(shared, "part"), ["d", "n", "part"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))

    none = F.lit(None).cast("string")
    columns = ["page_id", "url", "d", "n"]
    responses = marked.where(~revisit).select(*columns, F.col("html").alias("payload"), none.alias("refers_id"), none.alias("refers_target"), F.lit(None).cast("long").alias("refers_to"))
    _pack(responses, date, "a").write.option("compression", "none").parquet(f"{path}/responses")
    written = spark.read.schema(TABLE).parquet(f"{path}/responses")
    # one response stands for each shared payload, and is named by all its revisits
    held = identifiers(written).select(F.col("sha1").alias("d"), F.col("payload_bytes").alias("n"), "record_id", F.col("target").alias("refers_target"), F.col("page_id").alias("refers_to"))
    held = held.join(shared.select("d", "n"), ["d", "n"]).groupBy("d", "n").agg(F.min(F.struct("record_id", "refers_target", "refers_to")).alias("r"))
    held = replicated(held.select("d", "n", F.col("r.record_id").alias("refers_id"), "r.refers_target", "r.refers_to"), "part")
    again = marked.where(revisit).select(*columns).withColumn("part", spread("page_id")).join(held, ["d", "n", "part"])
    revisits = again.select(*columns, none.alias("payload"), "refers_id", "refers_target", "refers_to")
    _pack(revisits, date, "b").write.option("compression", "none").parquet(f"{path}/revisits")
    return spark.read.schema(TABLE).parquet(f"{path}/responses", f"{path}/revisits")


def identifiers(table: DataFrame) -> DataFrame:
    """The identifier map: where each record lies."""
    return table.select("bundle_id", "frame", F.inline("index"))


def _wanted(table: DataFrame, asked: DataFrame, few: bool = False) -> DataFrame:
    """Frames that hold asked records (rows of the identifier map), each with the list of those; ``few``: of a bounded number."""
    want = asked.groupBy("bundle_id", "frame").agg(F.collect_list(F.struct("record_id", "page_id", "refers_id", "refers_to", "offset", "length")).alias("want"))  # a frame's own records
    return table.select("bundle_id", "frame", "data").join(F.broadcast(want) if few else want, ["bundle_id", "frame"]).select("data", "want")


def _cut_out(batches):
    """(identifier entry, record bytes) of each asked record, one frame in memory at a time."""
    for b in batches:
        for i in range(b.num_rows):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(b.column(0)[i].as_py())
            yield [(w, raw[w["offset"] : w["offset"] + w["length"]]) for w in b.column(1)[i].as_py()]


def fetch(table: DataFrame, record_ids: DataFrame) -> DataFrame:
    """record_id and record bytes of the asked ids.

    The map (the frames' index column alone) names bundles and frames. A request for up to ``MOST_PLACES`` frames hands them to
    the scan, which skips the files, row groups and pages of all others, and meets its frames by a broadcast; a larger one
    joins them. Both give the same records.
    """
    asked = cut(identifiers(table).join(record_ids.select("record_id").distinct(), "record_id"))
    places = asked.select("bundle_id", "frame").distinct().limit(MOST_PLACES + 1).collect()
    few = len(places) <= MOST_PLACES
    if few:
        table = table.where(F.col("bundle_id").isin(sorted({p.bundle_id for p in places})) & F.col("frame").isin(sorted({p.frame for p in places})))

    def run(batches):
        for got in _cut_out(batches):
            yield pa.RecordBatch.from_arrays([pa.array([w["record_id"] for w, _ in got], pa.string()), pa.array([r for _, r in got], pa.binary())], names=["record_id", "record"])

    return map_batches(_wanted(table, asked, few), run, "record_id string, record binary")


def read_records(table: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Every record that the identifier map ``asked`` (by default, the whole one) names; digests are computed from payloads.

    A revisit has no payload; ``refers_to`` is the page_id of the record it names. Records that the map tells otherwise of fail.
    """
    names = ["record_id", "page_id", "target", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    arrow = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()])))

    def run(batches):
        for got in _cut_out(batches):
            rows = []
            for w, raw in got:
                head, http, payload = parse(raw)
                told, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
                response = head["WARC-Type"] == "response"
                if (head["WARC-Record-ID"], head.get("WARC-Refers-To")) != (w["record_id"], w["refers_id"]) or response and (digest(payload) != told or len(payload) != n):
                    raise ValueError(f"damaged record {w['record_id']}")
                rows.append((w["record_id"], w["page_id"], head["WARC-Target-URI"], head["WARC-Type"], n, told, w["refers_to"], payload if response else None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    ddl = "record_id string, page_id long, target string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return map_batches(_wanted(table, identifiers(table) if asked is None else asked), run, ddl)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = write_bundles(read_table(spark, sf_dir, "pages"), shared_dir(spark))
    return read_records(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

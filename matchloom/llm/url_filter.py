"""URL verdicts from a sorted digest array.

A list entry is a host and the start of a path, with a verdict and a rank. The list becomes one file: the entries' 64-bit
xxhash keys in order, their verdicts, and their full strings. Spark ships the file to every executor once; tasks map it into
memory, so that all Python workers of an executor share its pages. A url's candidates are each suffix of its host at a label
with each start of its path of a length that the list has; all candidates of a batch are probed by one vectorised binary
search, and a hit counts only if the stored string is the candidate's, whatever entries share its digest.

The file is built only while the list is within ``MOST_BYTES``, measured first; a longer list is joined to the candidates of
the distinct urls by Spark, with the same result.

Of the entries that fit, the lowest rank wins, then the longest (host and path together, in code points), then the longer
host. Repeated entries count once; of entries that differ in verdict alone, block wins.

Defined results: the host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path follows
up to ``?``, ``#`` or the end; both are empty for a null url or one without ``://``. An empty host fits no entry. Entries
that are no host and start of a path (null, an empty host, a path without its slash) fit nothing and are left out. Every row has one result, repeated rows as often as they come; extra columns stay.
"""

from __future__ import annotations

import mmap
import os
import string
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, fresh_name, map_batches, read_table

#: The longest list, in bytes of its file, that is mapped; beyond, it is joined.
MOST_BYTES = 64 << 20
BATCH_ROWS = 8192
ENTRY = "host string, path string, verdict string, rank int"
#: The base rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that mark a host as one of advertisements, gambling, pills, adult pages or spam.
HOST_WORDS = ("ad", "ads", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "loan", "loans", "lottery", "pharma", "pill", "pills", "poker", "porn", "sex", "slots", "spam", "tracker", "track", "viagra", "warez", "xxx")
_HIT = "struct<host: string, path: string, verdict: string, rank: int>"


def host_of(url: str | Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def deduped(entries: DataFrame) -> DataFrame:
    """One row for each host and path: the lowest rank's, of equals block."""
    first = F.min(F.struct("rank", F.when(F.col("verdict") == "block", 0).otherwise(1), "verdict")).alias("_f")
    whole = entries.where("host rlike '^[^/?#]+$' and path rlike '^(/[^?#]*)?$'")
    return whole.groupBy("host", "path").agg(first).select("host", "path", F.col("_f.verdict").alias("verdict"), F.col("_f.rank").alias("rank"))


class DigestArray:
    """The mapped file: counts, sorted keys, offsets of the strings, ranks, verdicts, and the strings."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = self.n = int(np.frombuffer(self.map, np.int64, 1)[0])
        at = 8
        self.keys, at = np.frombuffer(self.map, np.uint64, n, at), at + 8 * n
        self.offsets, at = np.frombuffer(self.map, np.int64, n + 1, at), at + 8 * (n + 1)
        self.ranks, at = np.frombuffer(self.map, np.int32, n, at), at + 4 * n
        self.blocks, at = np.frombuffer(self.map, np.uint8, n, at), at + n
        self.strings = at

    @staticmethod
    def write(path: str, rows: Iterator, n: int) -> None:
        """``rows`` of (key, string, rank, block) by key as an unsigned number; ``n`` of them."""
        keys, offsets, ranks, blocks = np.zeros(n, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n, np.int32), np.zeros(n, np.uint8)
        with open(path, "wb") as f:
            f.seek(8 + 8 * n + 8 * (n + 1) + 5 * n)
            for i, (key, text, rank, block) in enumerate(rows):
                text = text.encode()
                f.write(text)
                keys[i], offsets[i + 1], ranks[i], blocks[i] = key & (1 << 64) - 1, offsets[i] + len(text), rank, block
            f.seek(0)
            for a in (np.array([n], np.int64), keys, offsets, ranks, blocks):
                f.write(a.tobytes())

    def text(self, i: int) -> bytes:
        return self.map[self.strings + self.offsets[i] : self.strings + self.offsets[i + 1]]

    def probe(self, candidates: Sequence[bytes], keys: np.ndarray) -> np.ndarray:
        """The place of each candidate in the array, or -1; ``keys`` are its digests."""
        lo = np.searchsorted(self.keys, keys, "left")
        hi = np.searchsorted(self.keys, keys, "right")
        out = np.full(len(candidates), -1)
        for c in np.flatnonzero(hi > lo):
            out[c] = next((i for i in range(lo[c], hi[c]) if self.text(i) == candidates[c]), -1)
        return out


_open: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    """The executor's copy of a shipped file; a worker maps it once and drops those of earlier lists."""
    if name not in _open:
        _open.clear()
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def digest_of(text: bytes) -> int:
    """The key of a list entry, as Spark's own ``xxhash64`` gives it."""
    return xxhash.xxh64_intdigest(text, 42)


def ship(entries: DataFrame) -> str:
    """Write the file of ``entries`` (deduped) on the driver, hand it to Spark and return its name."""
    spark = entries.sparkSession
    text = F.concat("host", "path")  # a host has no slash and a path starts with one, so that no two entries give one string
    rows = cut(entries.select(F.xxhash64(text).alias("key"), text.alias("text"), "rank", (F.col("verdict") == "block").cast("int").alias("block")))
    name = f"urls-{uuid.uuid4().hex}.bin"
    own = os.path.join(SparkFiles.getRootDirectory(), f"{name}.build")
    os.makedirs(own, exist_ok=True)
    ordered = rows.orderBy(F.col("key") < 0, "key", "text")  # as unsigned numbers
    DigestArray.write(os.path.join(own, name), ((r.key, r.text, r.rank, r.block) for r in ordered.toLocalIterator()), rows.count())
    spark.sparkContext.addFile(os.path.join(own, name))
    return name


def candidates(host: str, path: str, lengths: Sequence[int]) -> list[tuple[str, str]]:
    """Each suffix of ``host`` at a label with each start of ``path`` of one of ``lengths``."""
    if not host:
        return []
    labels = host.split(".")
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [(h, p) for h in (".".join(labels[i:]) for i in range(len(labels))) if h for p in starts]


def _probed(urls: DataFrame, name: str, lengths: Sequence[int], hit: str, host: str, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _mapped(name)
        for b in batches:
            pairs = list(zip(b.column(host).to_pylist(), b.column(path).to_pylist()))
            place: dict[tuple[str, str], int] = {}
            asked = [[place.setdefault(c, len(place)) for c in candidates(h, p, lengths)] for h, p in pairs]
            texts = [(h + p).encode() for h, p in place]
            at = array.probe(texts, np.array([digest_of(t) for t in texts], np.uint64))
            known = {i: (int(array.ranks[at[i]]), -len(h) - len(p), -len(h), h, p, "block" if array.blocks[at[i]] else "allow") for i, (h, p) in enumerate(place) if at[i] >= 0}
            best = [min((known[i] for i in own if i in known), default=None) for own in asked]
            hits = [None if x is None else {"host": x[3], "path": x[4], "verdict": x[5], "rank": x[0]} for x in best]
            schema = pa.struct([("host", pa.string()), ("path", pa.string()), ("verdict", pa.string()), ("rank", pa.int32())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, schema)], names=[*b.schema.names, hit])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return map_batches(urls, run, f"{schema}, `{hit}` {_HIT}", BATCH_ROWS)


def _joined(urls: DataFrame, entries: DataFrame, lengths: Sequence[int], hit: str, host: str, path: str) -> DataFrame:
    """The same by a join, for lists of any length: candidates of the distinct urls meet the entries."""
    pairs = urls.select(F.col(host).alias("_h"), F.col(path).alias("_p")).where("_h <> ''").distinct()
    labels = F.split("_h", r"\.")
    hosts = pairs.withColumn("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    each = hosts.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where(F.col("n") <= F.char_length("_p"))
    fits = each.withColumn("path", F.substring(F.col("_p"), F.lit(1), F.col("n"))).join(entries, ["host", "path"])
    order = F.struct("rank", -F.char_length("host") - F.char_length("path"), -F.char_length("host"))
    best = fits.groupBy("_h", "_p").agg(F.min_by(F.struct("host", "path", "verdict", "rank"), order).alias(hit))
    return urls.join(best, (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left").drop("_h", "_p")


def judge(urls: DataFrame, entries: DataFrame, url: str = "url", name: str = "hit", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``urls`` with host, path and the entry that wins (null if none fits), in columns named ``name``_host, ``name``_path and ``name``."""
    host, path, hit = (fresh_name(urls, x) for x in (f"{name}_host", f"{name}_path", name))
    parted = urls.withColumns({host: host_of(url), path: path_of(url)})
    entries = cut(deduped(entries))
    facts = entries.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 21), F.lit(0)).alias("bytes"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    lengths = sorted(facts.lengths)
    if not lengths:
        return parted.withColumn(hit, F.lit(None).cast(_HIT))
    if facts.bytes > most_bytes:
        return _joined(parted, entries, lengths, hit, host, path)
    return _probed(parted, ship(entries), lengths, hit, host, path)


def marked_hosts(urls: DataFrame, words: Sequence[str] = HOST_WORDS, url: str = "url") -> DataFrame:
    """List entries that block each host of ``urls`` one of whose words, between dots and hyphens, is in ``words``; rank 1."""
    hosts = urls.select(host_of(url).alias("host")).where("host <> ''").distinct()
    marked = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, words)))
    return hosts.where(marked).select("host", F.lit("").alias("path"), F.lit("block").alias("verdict"), F.lit(1).alias("rank"))


def base_rules(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """List entries of ``rules``; rank 0, so that they bind wherever they fit."""
    return spark.createDataFrame([(*r, 0) for r in rules], ENTRY)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: a base rule's, else block for marked hosts, else allow."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, base_rules(spark).unionByName(marked_hosts(pages)))
    rule = F.when(F.col("hit.rank") == 0, F.concat("hit.host", "hit.path"))
    return judged.select("page_id", F.col("hit_host").alias("host"), F.col("hit_path").alias("path"), rule.alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))


_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SQL_WORDS = ", ".join(f"'{w}'" for w in HOST_WORDS)
ORACLE_OP11 = f"""WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(h, p, v) AS (VALUES {_SQL_RULES}),
f AS (SELECT rid, arg_max(h || p, (length(h) + length(p), length(h))) AS rule, arg_max(v, (length(h) + length(p), length(h))) AS v
  FROM u JOIN r ON ('.' || host) LIKE '%.' || h AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{_SQL_WORDS}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (rid)"""

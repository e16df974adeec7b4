"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of ten words (shorter items: the whole item) become a hash set. Every document's windows of
the same lengths are hashed in one pass over its word array and looked up; hits are verified word for word. The set
is broadcast only when its measured size is within ``BROADCAST_BYTES``. Beyond that, hashes and positions of the
documents' windows are joined with it by a shuffle, without their words; the documents that share a hash are then read
again and their hits verified.

Defined results: null and empty texts have no words and no hits; benchmark items without words have no windows;
items with a null id mark words but are not listed. There is one result row for every row of ``docs``, repeated ones
included; a null doc_id is a key like any other. An empty benchmark leaves every document clean. Extra columns are ignored by
``scan`` and kept by ``remove``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import read_table, replicated, spread, text_or_empty

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The measured bytes of windows up to which the set is broadcast.
BROADCAST_BYTES = 64 << 20
#: A document whose words are hit in more than this share is dropped; otherwise the hit words are cut out.
DROP_SHARE = 0.5
_ROW = -7046029254386353131


def words_of(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), 0)


def _window(words: Column, start: Column, width: Column | int) -> Column:
    return F.slice(words, start + 1, width)


def _window_hashes(words: Column, count: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(_window(words, i, width)))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """h (64-bit hash), win (the words joined by a space), len and items of every distinct benchmark window."""
    items = benchmark.select("item_id", words_of(text_or_empty()).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(width)))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len")))
    flat = items.select("item_id", "len", "w", starts.alias("at")).select("item_id", "len", _window(F.col("w"), F.col("at"), F.col("len")).alias("w"))
    flat = flat.select("item_id", "len", F.xxhash64("w").alias("h"), F.concat_ws(" ", "w").alias("win"))
    return flat.groupBy("h", "win", "len").agg(F.collect_set("item_id").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, spans (word ranges [at, at + len) of hits) and items of every row of ``docs``."""
    windows = benchmark_windows(benchmark, width)
    size = windows.agg(F.coalesce(F.sum(F.octet_length("win") + 8 * F.size("items") + 48), F.lit(0)), F.collect_set("len")).first()
    small, lengths = size[0] <= BROADCAST_BYTES, sorted(size[1])
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(text_or_empty()).alias("w"))
    base = base.withColumn("n_words", F.size("w"))
    count = {n: F.greatest(F.col("n_words") - n + 1, F.lit(0)) for n in lengths}
    hashes = [F.when(count[n] > 0, _window_hashes(F.col("w"), count[n], n)).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    # the first entry stands for the document itself, so that documents without hits stay
    hashed = base.withColumn("hs", F.concat(F.array(F.lit(_ROW)), *hashes))
    # outer, though no array is empty: for a plain explode Spark tests the array's size first and so computes it twice
    rows = hashed.select("doc_id", "text_hash", "n_words", "w", F.posexplode_outer("hs").alias("k", "h"))
    at, length, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for n in lengths:
        inside = (F.col("k") >= before) & (F.col("k") < before + count[n])
        at, length, before = F.when(inside, F.col("k") - before).otherwise(at), F.when(inside, n).otherwise(length), before + count[n]
    spelled = F.concat_ws(" ", _window(F.col("w"), F.col("at"), F.col("span")))
    if small:
        marker = docs.sparkSession.range(1).select(F.lit(_ROW).alias("h"), F.lit(None).cast("string").alias("win"), F.lit(None).cast("int").alias("len"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
        found = rows.join(F.broadcast(windows.unionByName(marker)), "h").withColumns({"at": at, "span": length})
        real = (F.col("k") > 0) & (F.col("span") == F.col("len")) & (spelled == F.col("win"))
        found = found.where((F.col("k") == 0) & F.col("win").isNull() | real)
        found = found.select("doc_id", "text_hash", "n_words", "items", F.when(F.col("k") > 0, F.struct("at", F.col("span").alias("len"))).alias("s"))
    else:
        # a window that very many documents share is dealt to several tasks
        narrow = rows.where("k > 0").select("doc_id", "text_hash", at.alias("at"), length.alias("span"), "h").withColumn("part", spread("text_hash", 8))
        met = narrow.join(replicated(windows.select("h", "len", "win", "items"), "part", 8), ["h", "part"]).where("span = len")
        # no more than the document's own windows, each with the benchmark's windows of one hash
        maybe = met.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).agg(F.collect_set(F.struct("at", "span", "win", "items")).alias("maybe"))
        joined = base.join(maybe, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left").select("doc_id", "text_hash", "n_words", "w", F.explode_outer(F.concat(F.array(F.lit(None).cast(maybe.schema["maybe"].dataType.elementType)), F.coalesce("maybe", F.array().cast(maybe.schema["maybe"].dataType)))).alias("m"))
        joined = joined.select("doc_id", "text_hash", "n_words", "w", F.col("m.at").alias("at"), F.col("m.span").alias("span"), F.col("m.win").alias("win"), F.col("m.items").alias("items"))
        found = joined.where(F.col("at").isNull() | (spelled == F.col("win")))
        found = found.select("doc_id", "text_hash", "n_words", "items", F.when(F.col("at").isNotNull(), F.struct("at", F.col("span").alias("len"))).alias("s"))
    # every row has one entry without a span; rows of one id and text come out as often as they have such entries
    found = found.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.collect_set("s").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count_if(F.col("s").isNull()).alias("rows"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["len"]).alias("end"), (a["n"] + F.greatest(s["at"] + s["len"] - F.greatest(a["end"], s["at"]), F.lit(0))).alias("n")),
    )
    found = found.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), covered["n"].cast("long").alias("n_hit"), "spans", "items", "rows")
    return found.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("_", "rows")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, drop_share: float = DROP_SHARE) -> DataFrame:
    """``docs`` without contamination: documents hit in more than ``drop_share`` of their words go, others lose the hit words."""
    hits = scan(docs, benchmark, width).where("n_hit > 0").dropDuplicates(["doc_id", "text_hash"])
    hits = hits.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), (F.col("n_hit") > drop_share * F.col("n_words")).alias("_hit_all"), F.col("spans").alias("_hit_spans"))
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_hash")), "left")
    joined = joined.where(F.coalesce(~F.col("_hit_all"), F.lit(True)))
    words, gaps = F.regexp_extract_all("text", F.lit(_ANY_CASE_WORD), 0), F.split("text", _ANY_CASE_WORD, -1)
    inside = lambda i: F.exists("_hit_spans", lambda s: (i >= s["at"]) & (i < s["at"] + s["len"]))
    rest = F.zip_with(F.zip_with(words, F.slice(gaps, 2, F.size(gaps)), lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), F.sequence(F.lit(0), F.size(words) - 1), lambda p, i: F.when(inside(i), F.lit("")).otherwise(p))
    cleaned = F.when(F.col("_hit_id").isNull() & F.col("_hit_hash").isNull(), F.col("text")).otherwise(F.concat(gaps[0], F.concat_ws("", rest)))
    changed = {"text": cleaned}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_hit_hash").isNull(), F.col("n_chars")).otherwise(F.length(cleaned).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT rid, item_id, x.n, i FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM ds) x JOIN bw ON x.g = bw.g AND x.n = bw.n),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN its USING (rid)
"""

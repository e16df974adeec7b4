"""Near copies: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more, and what they connect.

The first candidates are op6's: SimHash fingerprints of the five-word shingles within two bits, by pigeonhole blocks. Pairs at
0.8 differ in up to about 12 bits, and pigeonhole keys for 12 bits are so short that unrelated texts meet in numbers that grow
with the square of the input. So what two bits leave out is found in MinHash bands: ``BANDS`` = 24 keys of ``ROWS`` = 4 minima
each. A pair at similarity s shares a key with probability 1 - (1 - s^4)^24, at least 0.999996 at 0.8. Every candidate pair of
either kind is verified on the whole sets of 64-bit shingle hashes.

A key's texts are first verified against the one that shares most keys with others, so a large group of copies costs
one candidate a text and key. Texts of keys that these links don't all connect are then compared by their rarest
shingles: a text of n shingles at 0.8 or more to another shares one of its n - ceil(0.8 n) + 1 rarest ones with the
other's rarest, and no more shingles than both have from there on, nor than either has in common with any text. Pairs
that are still apart and pass these exact bounds are verified. No pair is lost, and texts of a large group that only
edits of their own keep apart make no pairs.

Defined results: words are as in SimHash (ASCII lower case, white space). Fewer than five words: the whole sequence is
the one shingle. Null, empty and wordless texts are copies of each other. Texts of equal words share a 64-bit node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut, map_batches, replicated, spread
from matchloom.llm.simhash import _LOWER, components, links, voted

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The 64-bit hashes of the word shingles, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, 42) for p in parts), np.uint64)


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles."""
    return np.unique(hashed(words, width))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def band_keys(hashes: np.ndarray) -> list[int]:
    """The signed keys of the bands of one set; a set without shingles has none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, i : i + 1024]).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, the hash of its text, the node of its words, its fingerprint, its number of shingles and its band keys."""

    def run(batches):
        for b in batches:
            nodes, prints, sizes, bands = [], [], [], []
            for text in b.column(2).to_pylist():
                words = _words(text)
                every = hashed(words, width)
                found = np.unique(every)
                prints.append(voted(every) if len(every) else 0)
                node = xxhash.xxh64_intdigest(b" ".join(words), 7)
                nodes.append(node - (1 << 64) if node >> 63 else node)
                sizes.append(len(found))
                bands.append(band_keys(found))
            columns = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "fp", "n", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, f"doc_id {kind}, text_hash long, node long, fp long, n long, bands array<long>")


def print_pairs(classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that the links of their SimHash fingerprints ``fp`` propose: one fingerprint's nodes with its
    smallest, and those of linked fingerprints. Each node and link gives one pair at most."""
    least = cut(classes.groupBy("fp").agg(F.min("node").alias("a")))
    same = classes.join(least, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    ends = [least.select(F.col("fp").alias(f"fp_{c}"), F.col("a").alias(c)) for c in "xy"]
    other = links(least.select("fp")).toDF("fp_x", "fp_y").join(ends[0], "fp_x").join(ends[1], "fp_y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(other)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have at least that similarity."""

    def run(batches):
        last, left = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, left = a, shingles(_words(x), width)
                keep.append(jaccard(left, shingles(_words(y), width)) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b"), run, "a long, b long", rows=64)


def close_pairs(open_: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of nodes in ``open_`` (node, root) of different roots that the bounds on shared shingles leave."""

    def run(batches):
        for batch in batches:
            sets = [shingles(_words(t), width) for t in batch.column(2).to_pylist()]
            size = np.array([len(x) for x in sets])
            which = pa.array(np.repeat(np.arange(len(sets)), size))
            hashes = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(np.repeat(size, size), pa.int64()), pa.array(hashes, pa.int64())], names=["node", "root", "n", "h"])

    sets = cut(map_batches(texts.join(open_, "node").select("node", "root", "text"), run, "node long, root long, n long, h long"))
    known = sets.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    # a text's own shingles, without those that no other open text has
    own = sets.join(known, "h").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("s"))
    alone = F.col("n") - F.size("s")
    reach = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1 - alone
    rare = own.where(reach > 0).select("node", "root", "n", F.size("s").alias("known"), alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), reach.cast("int"))).alias("i", "t"))
    rare = cut(rare.select("node", "root", "n", "known", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), F.col("t.h").alias("h")))
    a, b = (rare.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n", "known", "left"))) for s in "ab")
    need = (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-6
    close = (F.least("known_a", "known_b") >= need) & (F.least("left_a", "left_b") >= need)
    met = a.join(b, (a.h == b.h) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & close)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, node and root of every row of ``docs``; rows of one root are connected by near copies."""
    rows = cut(sketches(docs, width))
    classes = rows.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    prints = cut(print_pairs(classes.select("node", "fp")))
    keys = classes.select("node", "text_hash", "n", F.explode("bands").alias("k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    keyed = cut(keys.join(shared, "k"))
    wanted = keyed.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.sum("c").alias("w"))
    linked = classes.join(prints.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "text_hash")
    asked = wanted.select("node", "text_hash").unionByName(linked).distinct()
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(asked, "text_hash").groupBy("node").agg(F.min("text").alias("text"))
    texts = cut(texts)

    hubs = keyed.join(wanted.select("node", "w"), "node").groupBy("k").agg(F.max(F.struct("w", "node", "n")).alias("hub")).select("k", F.col("hub.node").alias("a"), F.col("hub.n").alias("m"))
    sized = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6
    stars = keyed.select("k", "n", F.col("node").alias("b")).join(hubs, "k").where(F.col("a") != F.col("b")).where(sized).select("a", "b").distinct()
    near = cut(verified(prints.unionByName(stars).distinct(), texts, similarity, width))
    roots = components(near)

    placed = cut(keyed.select("k", "node").join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root")))
    apart = placed.groupBy("k").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("k")
    rest = cut(close_pairs(placed.join(apart, "k").select("node", "root").distinct(), texts, similarity, width))
    roots = components(near.unionByName(verified(rest, texts, similarity, width)))
    # copies of one text are dealt to several tasks
    joined = rows.withColumn("part", spread()).join(replicated(roots, "part"), ["node", "part"], "left")
    return joined.select("doc_id", "text_hash", "node", F.coalesce("root", "node").alias("root"))

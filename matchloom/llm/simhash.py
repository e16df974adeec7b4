"""SimHash near-dedup: pigeonhole blocks, verified Hamming distance, connected components.

Two fingerprints within ``MAX_BITS`` = 2 differ in at most two of four 16-bit blocks, so they agree on at least
one of the six pairs of blocks: joining on the 32 bits of a pair of blocks loses no link. A block key that many
distinct fingerprints share is not joined with itself; its fingerprints are instead dealt by their one-bit
neighbours (themselves and 64 flips): any two within two bits meet at a common neighbour, and all that meet there
are within two bits of each other, so each meeting is one star of links. Either way is exact, and the second costs
65 rows a fingerprint, however dense the group is.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like others. Fewer than three
words: the whole sequence is the one shingle. Rows with equal texts share a fingerprint. component_id is the smallest
non-null doc_id of the component (null if it has none); repeated rows are all returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, map_batches, read_table, replicated, spread

MAX_BITS = 2
#: A block key with more distinct fingerprints than this is linked by one-bit neighbours.
DENSE_KEY = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return voted(np.fromiter((digest(s, seed) for s in shingles), np.uint64))


def voted(h: np.ndarray) -> int:
    """The signed fingerprint of shingle hashes, repeats included: the bits set in over half of them."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):  # a long text never needs more than a few MB
        part = h[i : i + 65536]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a long."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, width) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def links(classes: DataFrame, dense: int = DENSE_KEY) -> DataFrame:
    """Edges (a, b), a < b, whose transitive closure joins all distinct fingerprints ``fp`` within two bits."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pair = [F.struct(F.lit(10 * i + j).alias("which"), (block[i] * 65536 + block[j]).alias("bits")) for i in range(4) for j in range(i + 1, 4)]
    keys = classes.select("fp", F.explode(F.array(*pair)).alias("k")).select("fp", "k.which", "k.bits")
    sizes = keys.groupBy("which", "bits").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(keys.join(sizes, ["which", "bits"]))
    few = keyed.where(F.col("n") <= dense)
    a, b = few.select("which", "bits", F.col("fp").alias("a")), few.select("which", "bits", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    verified = a.join(b, ["which", "bits"]).where(F.col("a") < F.col("b")).where(close).select("a", "b")
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)))
    near = keyed.where(F.col("n") > dense).select("fp").distinct().select("fp", F.explode(flips).alias("meet"))
    first = near.groupBy("meet").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("meet", "a")
    stars = near.join(first, "meet").where("fp > a").select("a", F.col("fp").alias("b"))
    return verified.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root (its component's smallest node) by alternating large-star and small-star steps.

    Nothing is collected: each round is two shuffles over the links and ends in a written table. A star's centre
    gathers only a minimum, so a hub with very many links is summed map-side.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour moves to the smallest of the neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node's smaller neighbours and the node itself move to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of ``docs``."""
    prints = cut(fingerprints(docs, width))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(classes.select("fp")))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # a row without copies or links is its own component and needs no join; copies of one text are dealt to several tasks
    alone = (F.col("n") == 1) & F.col("component_id").eqNullSafe(F.col("first"))
    named = placed.join(least, "root").where(~alone).select("fp", "component_id", F.lit(True).alias("linked"))
    joined = prints.withColumn("part", spread()).join(replicated(named, "part"), ["fp", "part"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

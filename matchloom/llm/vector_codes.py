"""Product quantisation of vectors into bytes, with integer codebooks that every engine computes alike.

A vector's components become integers floor(1024 x) and are cut into four parts. Each part position has a codebook of 256
entries, which start as those parts of the smallest ids. A round broadcasts one kd-tree a codebook (its size is bound by
the number of entries, not of rows); tasks search it by branch and bound and send one sum and count an entry, which are added
up in whole numbers; each entry becomes the floor of its mean. A branch whose bound equals the best distance is still
visited, so of equally near entries the one with the lowest index wins.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; ids are ordered with null
last and equal ids by their vectors, so repeated rows are entries of their own; with fewer rows than entries, codebooks
have one entry a row; null labels are one group; no rows give no rows; extra columns are ignored. Vectors of several lengths, lengths
that four doesn't divide, and components so large that a squared distance would not fit in 63 bits are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, map_batches, read_table

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 4, 256, 4, 1024, 8
#: Rows that one search has in hand.
BATCH_ROWS = 4096
CODES = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


@dataclass
class _Node:
    """A box of entries: a leaf has their indexes, a branch two halves."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray
    halves: tuple[_Node, _Node] | None = None


class KdTree:
    """Nearest entries by squared Euclidean distance of integers; of equals the lowest index."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, dtype=np.int64)
        self.root = self._build(np.arange(len(self.entries)))

    def _build(self, index: np.ndarray) -> _Node:
        points = self.entries[index]
        node = _Node(points.min(axis=0), points.max(axis=0), index)
        spread = node.high - node.low
        if len(index) > LEAF and spread.max() > 0:
            order = index[np.argsort(points[:, spread.argmax()], kind="stable")]
            node.halves = (self._build(np.sort(order[: len(order) // 2])), self._build(np.sort(order[len(order) // 2 :])))
        return node

    @staticmethod
    def _bound(node: _Node, queries: np.ndarray) -> np.ndarray:
        """The squared distance of each query to the node's box, which no entry in it can undercut."""
        off = np.maximum(node.low - queries, 0) + np.maximum(queries - node.high, 0)
        return np.einsum("ij,ij->i", off, off)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry."""
        queries = np.asarray(queries, dtype=np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        found = np.zeros(len(queries), dtype=np.int64)

        def visit(node: _Node, at: np.ndarray, bound: np.ndarray) -> None:
            keep = bound <= best[at]  # equal bounds may hold a lower index
            at = at[keep]
            if not len(at):
                return
            if node.halves is None:
                for i in node.index:
                    off = queries[at] - self.entries[i]
                    d = np.einsum("ij,ij->i", off, off)
                    win = (d < best[at]) | ((d == best[at]) & (i < found[at]))
                    best[at[win]], found[at[win]] = d[win], i
                return
            one, two = node.halves
            first, second = self._bound(one, queries[at]), self._bound(two, queries[at])
            near = first <= second
            visit(one, at[near], first[near])
            visit(two, at, second)
            visit(one, at[~near], first[~near])

        visit(self.root, np.arange(len(queries)), self._bound(self.root, queries))
        return found, best


def components(vectors: DataFrame) -> DataFrame:
    """vec_id, label and integer components v of every row with a whole, finite vector."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    return vectors.where(x.isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("v"))


def _check(kept: DataFrame) -> int:
    """The length of all vectors; an error if there is not one that parts and 63 bits allow."""
    seen = kept.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("far")).first()
    if seen.lo is None:
        return 0
    if seen.lo != seen.hi or seen.lo % PARTS:
        raise ValueError(f"vectors have {seen.lo} to {seen.hi} components; they need one length that {PARTS} divides")
    if (2 * (seen.far or 0)) ** 2 * seen.hi >= 1 << 63:
        raise ValueError(f"a component of {seen.far} makes squared distances that don't fit in 63 bits")
    return seen.lo


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), dtype=np.int64).reshape(batch.num_rows, length)


def _sums(kept: DataFrame, length: int, trees) -> DataFrame:
    """part, entry, place, sum and count over all rows' nearest entries."""
    width = length // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = trees.value
        sums = [np.zeros((len(t.entries), width), dtype=np.int64) for t in books]
        counts = [np.zeros(len(t.entries), dtype=np.int64) for t in books]
        for b in batches:
            v = _matrix(b, length)
            for p, tree in enumerate(books):
                own = v[:, p * width : (p + 1) * width]
                code, _ = tree.nearest(own)
                np.add.at(sums[p], code, own)
                counts[p] += np.bincount(code, minlength=len(tree.entries))
        for p in range(PARTS):
            used = np.flatnonzero(counts[p])
            if len(used):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()), "n": pa.array(counts[p][used]), "s": pa.array(list(sums[p][used]), pa.list_(pa.int64()))})

    partial = map_batches(kept.select("v"), run, "part int, entry int, n long, s array<long>", BATCH_ROWS)
    placed = partial.select("part", "entry", "n", F.posexplode("s").alias("place", "x"))
    return placed.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))


def fit(kept: DataFrame, length: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks: one array of integer entries for each part."""
    width, context = length // PARTS, kept.sparkSession.sparkContext
    first = np.array([r.v for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()], dtype=np.int64)
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    for _ in range(rounds):
        trees = context.broadcast([KdTree(b) for b in books])
        for r in _sums(kept, length, trees).collect():  # a number an entry and place, whatever the number of rows
            books[r.part][r.entry, r.place] = int(r.s) // r.n
        trees.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def assign(kept: DataFrame, length: int, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every row."""
    width, trees = length // PARTS, kept.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b, length)
            codes, error = np.zeros((len(v), PARTS), dtype=np.uint8), np.zeros(len(v), dtype=np.int64)
            for p, tree in enumerate(trees.value):
                codes[:, p], d = tree.nearest(v[:, p * width : (p + 1) * width])
                error += d
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = dict(kept.dtypes)["label"]
    return map_batches(kept, run, f"vec_id long, label {kind}, code string, error long", BATCH_ROWS)


def decode(codes: DataFrame, books: list[np.ndarray], column: str = "code") -> DataFrame:
    """``codes`` with ``vector``, the components that the code stands for, divided by the scale."""
    tables = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def look_up(code: pd.Series) -> pd.Series:
        return code.map(lambda c: None if c is None else np.concatenate([b[i] for b, i in zip(tables.value, bytes.fromhex(c))]) / SCALE)

    return codes.withColumn("vector", look_up(column))


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all whole vectors (vec_id, label, code, error), and the codebooks."""
    kept = cut(components(vectors))
    length = _check(kept)
    if not length:
        if not kept.isEmpty():
            raise ValueError("vectors have no components")
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    books = fit(kept, length, entries, rounds)
    return cut(assign(kept, length, books)), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, and their errors by row and label."""
    codes, books = compress(read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    totals = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Brute-force search in SQL: all entries of a codebook for each part; dot products of whole numbers are exact in doubles."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""a{r} AS (SELECT t.rid, t.part, min((CAST(t.vv - 2 * list_dot_product(t.v, b.v) + b.vv AS BIGINT)) * 256 + b.entry) AS best
  FROM t JOIN b{r} b USING (part) GROUP BY t.rid, t.part)""")
        if r < ROUNDS:
            rounds.append(f"""m{r} AS (SELECT part, entry, list(CAST(x AS DOUBLE) ORDER BY place) AS v FROM (
  SELECT t.part, best % 256 AS entry, u.place, floor(sum(CAST(t.v[u.place] AS BIGINT)) / count(*)) AS x
  FROM a{r} JOIN t USING (rid, part), (SELECT unnest(range(1, len(t.v) + 1)) AS place) u GROUP BY 1, 2, 3) GROUP BY part, entry)""")
            rounds.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, v, list_dot_product(v, v) AS vv FROM (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry)))")
    last = ROUNDS
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid, * FROM (
  SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true))),
t AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS vv FROM (SELECT rid, part, list_slice(v, part * len(v) // {PARTS} + 1, (part + 1) * len(v) // {PARTS}) AS v
  FROM k, (SELECT unnest(range({PARTS})) AS part))),
b0 AS MATERIALIZED (SELECT part, rid AS entry, v, vv FROM t WHERE rid < {ENTRIES}),
{", ".join(rounds)},
e AS MATERIALIZED (SELECT rid, string_agg(format('{{:02x}}', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{last} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) FOR x IN v], ','), ',' ORDER BY part, entry)) FROM b{last}) AS codebooks_sha256
FROM e JOIN k USING (rid)"""


ORACLE_OP12 = _oracle()

"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.sources.shared import Store, shared_dir

__all__ = ["Store", "shared_dir"]

#: Rows that an operator's Python code has in hand at once. Spark itself closes a batch at ``maxBytesPerBatch`` (64 MB).
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that lost executors don't cost a rerun."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow``, handing Spark's batches on in slices of at most ``rows`` rows. No session setting is touched.

    Workers are used again, so what a task no longer needs is given back at its end.
    """

    def sliced(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    def run(batches):
        yield from fn(sliced(batches))
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    while stem.lower() in {c.lower() for c in df.columns}:
        stem += "_"
    return stem


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def spread(copies: str | Column = "doc_id", parts: int = 16) -> Column:
    """A small number from a row's own value, to deal the rows of one hot key to ``parts`` tasks."""
    return F.pmod(F.xxhash64(copies), F.lit(parts)).cast("int")


def replicated(df: DataFrame, name: str, parts: int = 16) -> DataFrame:
    """``df`` once for each number that ``spread`` gives: the other side of a join on a key and that number."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

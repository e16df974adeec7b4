"""Scans and sinks: CSV feeds, partitioned folders, JSON documents and the history store."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


CORRUPT, FILE = "_corrupt_row", "_file"


def headers(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """file and header, the first line with text, of every file of a path or pattern that has one: found by the executors in one job.

    A line's place is that of its split and its own within it; only lines of a file's first split are compared, map-side. The
    job reads the files as lines once; a header that runs over several lines is not supported.
    """
    lines = spark.read.schema("line string").csv(path, encoding=encoding, sep="\x01", quote="", comment="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    first = lines.select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")).where("at = 0")
    return first.groupBy("file").agg(F.min_by("line", "i").alias("header"))


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str], encoding: str = "UTF-8", corrupt: bool = False) -> DataFrame:
    """A CSV feed as strings in the given columns, by header name; absent ones are null.

    Every file is read by its own header: files of one header form one scan, and the scans are joined by name. Short and
    long rows stay, with nulls for what they lack; with ``corrupt`` their text is kept in ``_corrupt_row``.
    """
    return _by_header(spark, path, columns, encoding, corrupt).drop(FILE)


def _columns(line: str) -> tuple[str, ...]:
    """The names in a header line, as Spark's own reader has them: empty ones by place, repeated ones with their place."""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    lower = [n.lower() for n in names]
    return tuple(f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names))


def _by_header(spark: SparkSession, path: str | list[str], columns: Sequence[str], encoding: str = "UTF-8", corrupt: bool = False) -> DataFrame:
    by_header: dict[tuple[str, ...], list[str]] = {}
    # one row a different header, with its files: a listing, whose jobs don't grow with the files
    for r in headers(spark, path, encoding).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect():
        by_header.setdefault(_columns(r.header), []).extend(r.files)
    fields = [*columns, *([CORRUPT] if corrupt else []), FILE]
    out = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in fields]))
    for header, files in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, CORRUPT)])
        raw = spark.read.schema(schema).csv(files, header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        have = {c.lower(): c for c in header}
        picked = [(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast("string").alias(c) for c in columns]
        out = out.unionByName(raw.select(*picked, *([CORRUPT] if corrupt else []), F.col("_metadata.file_path").alias(FILE)))
    return out


def read_or_empty(spark: SparkSession, fmt: str, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A table, or an empty one of the same schema where the path doesn't exist."""
    try:
        return spark.read.format(fmt).options(**options).schema(schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_year_folders(spark: SparkSession, root: str, prefix: str, file: str, columns: Sequence[str]) -> DataFrame:
    """All ``root``/``prefix``_<year>/``file``; ``year`` comes from the folder's name and folders without one are left out."""
    raw = _by_header(spark, f"{root}/{prefix}_*/{file}", columns)
    year = F.regexp_extract(FILE, rf"/{prefix}_(?:[^/]*_)?(\d+)/", 1).try_cast("int")
    return raw.withColumn("year", year).drop(FILE).where("year is not null")


def first_of(df: DataFrame, alternates: Sequence[str], name: str):
    """The first non-null of several columns that feeds call differently; null if none exists."""
    there = [F.col(f"`{c}`") for c in alternates if c in df.columns]
    return (F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def patched(document: DataFrame, patch: dict[str, str]) -> DataFrame:
    """A map column ``doc`` with the entries of ``patch`` put over its own (a shallow merge)."""
    over = F.create_map(*(F.lit(x) for kv in patch.items() for x in kv))
    rest = F.map_filter("doc", lambda k, _: ~k.isin(*patch))
    return document.withColumn("doc", F.map_concat(rest, over))


HISTORY = ("id", "created_at", "map", "cutoff_year", "winner", "probability", "request_json", "response_json")
_REQUEST = "team_a array<struct<player:string,agent:string>>, team_b array<struct<player:string,agent:string>>"


def init_history(spark: SparkSession, path: str | None) -> bool:
    """Create an empty store if a path is configured and holds none; whether there is a store now."""
    if not path:
        return False
    schema = "id string, created_at timestamp, map string, cutoff_year int, winner string, probability double, request_json string, response_json string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return True


def save_prediction(spark: SparkSession, path: str | None, request: dict, response: dict) -> bool:
    """Add one prediction, if a store is configured; whether it was."""
    if not path:
        return False
    row = (request["map"], request["cutoff_year"], response["winner"], response["probability"], json.dumps(request), json.dumps(response))
    append_history(spark.createDataFrame([row], "map string, cutoff_year int, winner string, probability double, request_json string, response_json string"), path)
    return True


def append_history(rows: DataFrame, path: str) -> None:
    """Add predictions (all columns but id and created_at) to the store, each with an id of its own and the time."""
    rows.withColumns({"id": F.uuid(), "created_at": F.current_timestamp()}).select(*HISTORY).write.mode("append").parquet(path)


def history_page(store: DataFrame, limit: int = 50, offset: int = 0, order: str = "created_at", key: str = "id") -> DataFrame:
    """Newest first; limit is clamped to 1..200 and offset to 0 and up."""
    return store.orderBy(F.desc(order), key).offset(max(0, offset)).limit(min(200, max(1, limit)))


def history_list(store: DataFrame, limit: int = 50, offset: int = 0, order: str = "created_at", key: str = "id") -> DataFrame:
    """``history_page`` with ``total``, the number of all predictions, on each of its rows, and on one row of nulls if it has none."""
    total = store.agg(F.count("*").alias("total"))
    return total.join(history_page(store, limit, offset, order, key), F.lit(True), "left").select(*store.columns, "total")  # one row against a page


def history_after(store: DataFrame, after: tuple | None, limit: int = 50, order: str = "created_at", key: str = "id") -> DataFrame:
    """The page that follows the row with ``after`` (its order value and key), newest first; the first page for None.

    The position is a filter that the scan can use, and only ``limit`` rows of each task are sorted on: a late page costs what
    the first one does, where an offset sorts all rows before it.
    """
    rows = store
    if after is not None:
        at, k = (F.lit(v) for v in after)
        rows = store.where((F.col(order) < at) | ((F.col(order) == at) & (F.col(key) > k)))
    return rows.orderBy(F.desc(order), key).limit(min(200, max(1, limit)))


def history_get(store: DataFrame, value, key: str = "id") -> DataFrame:
    return store.where(F.col(key) == value)


def request_lists(store: DataFrame, request: str = "request_json") -> DataFrame:
    """The store with player and agent arrays of both teams, read from the request's JSON."""
    r = F.from_json(F.col(request), _REQUEST)
    return store.select("*", *(r[f"team_{s}"][f].alias(f"{f}s_{s}") for s in "ab" for f in ("player", "agent")))

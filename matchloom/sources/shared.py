"""Tables that jobs write to the shared folder: materialised steps, and a store of batches published by a manifest."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Where none is configured, a local session gets one of its own; a
    cluster is refused, as its executors would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Bytes of a row group before compression. A task reads whole row groups, and well compressed tables of the default 128 MB a
#: group have so few that some tasks read all rows while the other cores wait.
ROW_GROUP = 8 << 20


def written(df: DataFrame, even: bool = True, by: Iterable[str] = ()) -> DataFrame:
    """``df``, computed once: written in partitions of even size to the shared folder and read back, so that many jobs can
    use it and lost executors don't cost a rerun of what is before it. Without ``even`` the partitions stay as they are,
    which saves a shuffle of all rows. Who filters by the columns of ``by`` reads only the files of what they ask for."""
    path = shared_dir(df.sparkSession)
    (df.hint("rebalance") if even else df).write.partitionBy(*by).options(**{"compression": "zstd", "parquet.block.size": str(ROW_GROUP)}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Batches of rows under a folder, each written to a fresh path and then published by one row of a manifest.

    Readers see published batches only, so a batch that fails leaves nothing that is read, and no published batch is ever
    written over. A batch id that is in the manifest is not committed again: a replay changes nothing. Of two writers that
    publish one id at the same time, the first path in order counts. A batch may replace others; from its one manifest row
    on, readers see it instead of them. What a batch replaces must be what it was made from: take one snapshot of
    ``batches()`` and hand it both to ``read`` and to ``commit``, so that a batch published meanwhile stays.

    ``partition_by`` names the columns that every batch is laid out by.
    """

    _MANIFEST = "batch string, path string, replaces array<string>"

    def __init__(self, spark: SparkSession, root: str, partition_by: Iterable[str] = ()):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), tuple(partition_by)

    def _rows(self) -> list:
        """The manifest: one row a batch, so its size is the number of commits."""
        try:
            return self.spark.read.schema(self._MANIFEST).parquet(f"{self.root}/manifest").select("batch", "path", "replaces").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def batches(self) -> dict[str, str]:
        """Path of each published batch that no other replaces."""
        rows = self._rows()
        gone = {b for r in rows for b in r.replaces}
        found: dict[str, str] = {}
        for r in sorted(rows, key=lambda r: (r.batch, r.path)):
            if r.batch not in gone:
                found.setdefault(r.batch, r.path)
        return found

    def commit(self, batch: str, rows: DataFrame, replaces: Iterable[str] = ()) -> bool:
        """Write and publish ``rows``; False, with nothing done, if the id is published already."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch!r}")
        if any(r.batch == batch for r in self._rows()):
            return False
        path = f"data/{batch}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*self.partition_by).parquet(f"{self.root}/{path}")
        note = self.spark.createDataFrame([(batch, path, list(replaces))], self._MANIFEST)
        note.coalesce(1).write.parquet(f"{self.root}/manifest/note={uuid.uuid4().hex}")  # a folder each: writers don't meet
        return True

    def read(self, schema: str, batches: dict[str, str] | None = None) -> DataFrame:
        """The rows of the given batches, or of all that are published."""
        paths = (self.batches() if batches is None else batches).values()
        frames = [self.spark.read.schema(schema).parquet(f"{self.root}/{p}") for p in paths]
        if not self.partition_by and frames:
            return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths))
        out = self.spark.createDataFrame([], schema) if not frames else frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

"""Cleaning a corpus in five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
rereads it as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bpe, decontam, nearcopies, quality, secrets
from matchloom.llm.common import cut, fresh_name, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    field = quality.train(spark, docs, read_table(spark, sf_dir, "labels"))
    name = fresh_name(docs, "quality_rules")
    return quality.judge(docs, field).where(F.col(name)["kept"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id and text hash stays; rows without an id are all kept."""
    id_, hash_ = fresh_name(docs, "_kept_id"), fresh_name(docs, "_kept_hash")
    least = nearcopies.near_copies(docs).where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    kept = least.select(F.col("row.doc_id").alias(id_), F.col("row.text_hash").alias(hash_))
    same = (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    named = docs.join(kept, same).dropDuplicates([id_, hash_]).select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly benchmark text go; others lose the benchmark's passages."""
    return decontam.remove(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind."""
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and their number, and the digest of the decoded bytes."""
    ranks = bpe.public_ranks()
    both = bpe.decode_chunks(bpe.encode_chunks(docs, ranks), ranks)
    return both.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]

#: Near-dedup, the labelling field and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

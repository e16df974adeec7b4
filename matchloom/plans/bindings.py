"""The driver's tables seen as matches and participants, in Spark and in SQL.

Orders are matches (the year of the order date, priority as map, customer as team, status F/O/P as label 1/0/none);
line items are participants (status F/O as side a/b, supplier as player, brand as agent, part type as role).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_key"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("map"), F.col("o_custkey").alias("team"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("label"), F.floor("o_totalprice").cast("double").alias("margin"), F.col("o_orderdate").alias("date"),
    )


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_key"), F.when(F.col("l_linestatus") == "F", "a").otherwise("b").alias("side"), F.col("l_suppkey").alias("player"),
        F.col("l_partkey").alias("part"), F.floor("l_quantity").cast("double").alias("qty"), F.floor("l_extendedprice").cast("double").alias("price"), F.col("l_linenumber").alias("line"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("agent"), F.col("p_type").alias("role"))
    return lines.join(parts, "part")


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with their match's year, map, team and outcome for their side."""
    m = matches(spark, sf_dir).select("match_key", "year", "map", "team", "label", "margin")
    won = F.when(F.col("side") == "a", F.col("label")).otherwise(1 - F.col("label"))
    return participants(spark, sf_dir).join(m, "match_key").withColumn("won", won)


M = """m AS (SELECT o_orderkey AS match_key, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS map, o_custkey AS team,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label, CAST(floor(o_totalprice) AS DOUBLE) AS margin, o_orderdate AS date FROM orders)"""
P = """p AS (SELECT l_orderkey AS match_key, CASE l_linestatus WHEN 'F' THEN 'a' ELSE 'b' END AS side, l_suppkey AS player, l_partkey AS part,
  CAST(floor(l_quantity) AS DOUBLE) AS qty, CAST(floor(l_extendedprice) AS DOUBLE) AS price, l_linenumber AS line, p_brand AS agent, p_type AS role
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
A = M + ",\n" + P + """,
a AS (SELECT p.*, year, map, team, label, margin, CASE WHEN side = 'a' THEN label ELSE 1 - label END AS won FROM p JOIN m USING (match_key))"""

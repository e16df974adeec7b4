"""Insight aggregates: rates with support, top lists, shares, bins and nearest compositions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_rate(df: DataFrame, keys: Sequence[str], won: str, support: int = 10) -> DataFrame:
    """n and win rate of each group with at least ``support`` rows that have an outcome."""
    return df.where(F.col(won).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(won).alias("win_rate")).where(F.col("n") >= support)


def compositions(players: DataFrame, match: str, side: str, agent: str, size: int = 5) -> DataFrame:
    """The first ``size`` different agents of each side that has as many, as a sorted '|'-joined key."""
    sets = players.groupBy(match, side).agg(F.array_sort(F.collect_set(agent)).alias("s")).where(F.size("s") >= size)
    return sets.select(match, side, F.array_join(F.slice("s", 1, size), "|").alias("comp"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank; Spark keeps only k rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def top_compositions(comps: DataFrame, by: str, won: str, support: int = 5, k: int = 10) -> DataFrame:
    rated = group_rate(comps, [by, "comp"], won, support)
    return top_per_group(rated, [by], [F.desc("win_rate"), F.asc("comp")], k)


def pick_rates(players: DataFrame, period: str, agent: str, match: str, won: str, slots: int = 10) -> DataFrame:
    """Picks, pick rate (over ``slots`` a match) and win rate by (period, agent)."""
    base = players.groupBy(period).agg(F.count_distinct(match).alias("matches"))
    picks = players.groupBy(period, agent).agg(F.count("*").alias("picks"), F.avg(won).alias("win_rate"))
    return picks.join(base, period).select(period, agent, "picks", (F.col("picks") / (F.col("matches") * slots)).alias("pick_rate"), "win_rate")


def wide_pick_rates(df: DataFrame, counts: Sequence[str], period: str, won: str, slots: int = 10) -> DataFrame:
    """The same from one count column an agent."""
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("agent"), F.col(c).cast("double").alias("n")) for c in counts)))
    base = df.groupBy(period).agg(F.count("*").alias("matches"))
    long = df.select(period, won, items.alias("i")).select(period, won, "i.agent", "i.n")
    agg = long.groupBy(period, "agent").agg(F.sum("n").alias("picks"), F.try_divide(F.sum(F.col("n") * F.col(won)), F.sum("n")).alias("win_rate"))
    return agg.join(base, period).select(period, "agent", "picks", (F.col("picks") / (F.col("matches") * slots)).alias("pick_rate"), "win_rate")


def shares(df: DataFrame, group: str, item: str, item_known: Column | None = None) -> DataFrame:
    """n of each (group, item) and its share of the group's classified items."""
    rows = df.where(F.col(item).isNotNull() if item_known is None else item_known)
    n = rows.groupBy(group, item).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def meta_shift(picks: DataFrame, period: str, agent: str, rows: DataFrame, top: int = 10, per_row: int = 2) -> DataFrame:
    """Percentage of sides by (period, agent) for the ``top`` agents overall."""
    best = picks.groupBy(agent).agg(F.count("*").alias("n")).orderBy(F.desc("n"), agent).limit(top).select(agent)
    base = rows.groupBy(period).agg((F.count("*") * per_row).alias("sides"))
    n = picks.join(F.broadcast(best), agent).groupBy(period, agent).agg(F.count("*").alias("n"))  # ``top`` rows
    return n.join(base, period).select(period, agent, (F.col("n") / F.col("sides") * 100).alias("pick_pct"))


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percentage of nulls of each column, from one pass."""
    names = list(columns or df.columns)
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), (F.col(c) * 100).alias("null_pct")) for c in names))).alias("r")).select("r.*")


def null_rate_by(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg((F.avg(F.col(column).isNull().cast("double")) * 100).alias("null_pct"))


def equal_width_rate(df: DataFrame, x: str, won: str, bins: int = 10) -> DataFrame:
    """n and rate of equal-width bins, right-closed, the lowest value in the first; empty bins are absent.

    Edges are compared, not computed from a quotient, so values on an edge fall where they should.
    """
    edge = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    inner = [(F.col(x) > F.col("_lo") + i * width).cast("int") for i in range(1, bins)]
    binned = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(edge)).withColumn("bin", 1 + reduce(lambda a, b: a + b, inner))  # the edges are one row
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(won).alias("rate"))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins; values outside go to bin 0 or bins + 1, the upper edge to the last bin."""
    b = F.when(F.col(x) == high, bins).otherwise(F.width_bucket(F.col(x), F.lit(float(low)), F.lit(float(high)), F.lit(bins)))
    return df.where(F.col(x).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def reliability(df: DataFrame, probability: str, label: str, bins: int = 5) -> DataFrame:
    """Confidence |2p - 1| in bins of equal width, the last right-closed: n, accuracy and mean confidence."""
    c = F.abs(2 * F.col(probability) - 1)
    b = F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")
    hit = ((F.col(probability) >= 0.5).cast("int") == F.col(label)).cast("double")
    return df.select(b.alias("bin"), c.alias("c"), hit.alias("hit")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("c").alias("confidence"))


def nearest(comps: DataFrame, vector: Sequence[str], target: Sequence[float], scale: float = 10.0) -> DataFrame:
    """The composition nearest to ``target`` (ties: more games, higher rate, first key) and the game-weighted mean similarity."""
    d = reduce(lambda a, b: a + b, (F.abs(F.col(v) - float(t)) for v, t in zip(vector, target, strict=True)))
    rows = comps.withColumn("similarity", 1 - d / scale)
    # a key's order is reversed by its rank among equals, so the maximum takes the first
    best = F.min_by(F.struct("comp", "similarity", "n", "win_rate"), F.struct((-F.col("similarity")).alias("a"), (-F.col("n")).alias("b"), (-F.col("win_rate")).alias("c"), F.col("comp").alias("d")))
    return rows.agg(best.alias("b"), (F.sum(F.col("similarity") * F.col("n")) / F.sum("n")).alias("mean_similarity")).select("b.*", "mean_similarity")


def fit_or_rule(dim: DataFrame, fit: DataFrame, on: Sequence[str], rule: Column) -> DataFrame:
    """Every member of a dimension with its measured verdict, or the rule's where nothing was measured."""
    r = F.col("win_rate")
    data = F.when(r >= 0.52, "fit").when(r <= 0.48, "weak").otherwise("ok")
    joined = dim.join(fit, list(on), "left")
    return joined.withColumns({"verdict": F.when(r.isNotNull(), data).otherwise(rule), "basis": F.when(r.isNotNull(), "data").otherwise("rule")})


def frequent(df: DataFrame, value: str, pattern: str | None = None) -> DataFrame:
    """Values by falling frequency, ties by value; only those that match ``pattern``."""
    rows = df.where(F.col(value).isNotNull())
    rows = rows if pattern is None else rows.where(F.col(value).rlike(pattern))
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value)


def featured(available: DataFrame, value: str, curated: Sequence[str], limit: int = 80) -> DataFrame:
    """The curated values that are available, in the curated order."""
    spark = available.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(curated)], f"ordinal int, {value} string")
    return names.join(available.select(value).distinct(), value, "left_semi").orderBy("ordinal").limit(limit)


def top_contributions(df: DataFrame, key: str, feature: str, importance: str, value: str, k: int = 8) -> DataFrame:
    """The k features of each key with the largest |importance * value|; by importance where all products are zero."""
    product = F.abs(F.col(importance) * F.col(value))
    some = F.max(product).over(Window.partitionBy(key)) > 0
    ranked = df.withColumn("contribution", F.when(some, product).otherwise(F.col(importance)))
    return top_per_group(ranked, [key], [F.desc("contribution"), F.asc(feature)], k)

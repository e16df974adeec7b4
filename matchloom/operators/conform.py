"""Conforming feeds to matches and participants: filters, canonical sides, pairing, keyed dedup and cardinality gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equals_ignoring_case(c: Column, value: str) -> Column:
    return F.lower(F.trim(c)) == value.lower()


def allowed_source(c: Column, prefixes: Sequence[str]) -> Column:
    """Whether a source starts with an allowed prefix; null sources don't."""
    return F.coalesce(reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes)), F.lit(False))


def source_contract(matches: DataFrame, players: DataFrame, prefixes: Sequence[str], key: str, source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches of allowed sources, the players of those matches that are themselves of allowed sources, and rows excluded by source."""
    kept = matches.where(allowed_source(F.col(source), prefixes))
    people = players.join(kept.select(key), key, "left_semi").where(allowed_source(F.col(source), prefixes))
    out = matches.where(~allowed_source(F.col(source), prefixes)).groupBy(source).agg(F.count("*").alias("excluded"))
    return kept, people, out


def decisive(df: DataFrame, a: str, b: str, label: str = "label") -> DataFrame:
    """Rows with two different scores, and 1 where the first is higher."""
    return df.where(F.col(a) != F.col(b)).withColumn(label, (F.col(a) > F.col(b)).cast("int"))


def canonical_sides(df: DataFrame, pairs: Sequence[tuple[str, str]], label: str | None = None) -> DataFrame:
    """Swap each (left, right) pair of columns, the first of which decides, so that left <= right in binary order; the label follows."""
    left, right = pairs[0]
    keep = F.col(left) <= F.col(right)
    new = {c: F.when(keep, F.col(c)).otherwise(F.col(d)) for a, b in pairs for c, d in ((a, b), (b, a))}
    if label:
        new[label] = F.when(keep, F.col(label)).otherwise(1 - F.col(label))
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def without_forfeits(df: DataFrame, a: str, b: str) -> DataFrame:
    """Drop rows in which either score is zero; null scores stay."""
    return df.where((F.coalesce(F.col(a), F.lit(-1)) != 0) & (F.coalesce(F.col(b), F.lit(-1)) != 0))


def keep_first(df: DataFrame, keys: Sequence[str], priority: Sequence[Column]) -> DataFrame:
    """One row of each key, the first by ``priority``, which should be a total order.

    The maximum of a struct is combined map-side, so a key with very many rows never meets in one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [p.alias(f"_p{i}") for i, p in enumerate(priority)]
    best = df.select(*keys, F.struct(*order, *rest).alias("_row")).groupBy(*keys).agg(F.min("_row").alias("_row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns))


def source_dedup(matches: DataFrame, key: str, dedup_key: str, rank: Column) -> DataFrame:
    """First one row of each key, then one of each dedup key; better (smaller) ranks first, ties by key."""
    once = keep_first(matches, [key], [rank, F.col(dedup_key)])
    return keep_first(once, [dedup_key], [rank, F.col(key)])


def side_counts(players: DataFrame, key: str, side: str, sides: Sequence[str] = ("a", "b")) -> DataFrame:
    return players.groupBy(key).agg(*(F.count_if(F.col(side) == s).alias(f"n_{s}") for s in sides))


def full_sides(players: DataFrame, key: str, side: str, size: int, at_least: bool = False) -> DataFrame:
    """Keys whose sides a and b both have exactly (or at least) ``size`` rows."""
    n = side_counts(players, key, side)
    return n.where((F.col("n_a") >= size) & (F.col("n_b") >= size) if at_least else (F.col("n_a") == size) & (F.col("n_b") == size))


def gate(matches: DataFrame, players: DataFrame, key: str, side: str, size: int, at_least: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches with full sides, their players, and the matches dropped."""
    ok = full_sides(players, key, side, size, at_least).select(key)
    return matches.join(ok, key, "left_semi"), players.join(ok, key, "left_semi"), matches.join(ok, key, "left_anti")


def lineup(players: DataFrame, key: str, side: str, order: Sequence[str], size: int = 5, distinct: Sequence[str] = ()) -> DataFrame:
    """The first ``size`` players of each side by ``order`` (duplicates in ``distinct`` once), numbered from 1."""
    rows = players
    if distinct:
        rows = keep_first(rows, [key, side, *distinct], [F.col(c) for c in order])
    w = Window.partitionBy(key, side).orderBy(*order)
    return rows.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= size)


def assembled(players: DataFrame, key: str, side: str, order: Sequence[str], size: int = 5) -> DataFrame:
    """Lineups of the keys whose both sides reach ``size``."""
    first = lineup(players, key, side, order, size)
    return first.join(full_sides(first, key, side, size).select(key), key, "left_semi")


def slots(players: DataFrame, key: str, side: str, player: str) -> DataFrame:
    """Players of each side numbered from 1 by name."""
    return players.withColumn("player_slot", F.row_number().over(Window.partitionBy(key, side).orderBy(player)))


def reassembled(players: DataFrame, key: str, side: str, order: Sequence[str], fields: Sequence[str], size: int = 5) -> DataFrame:
    """One row a key: the two lineups as arrays of structs, null where either side is short."""
    rows = lineup(players, key, side, order, size, fields).groupBy(key, side).agg(F.array_sort(F.collect_list(F.struct("slot", *fields))).alias("l"))
    wide = rows.groupBy(key).agg(*(F.max(F.when(F.col(side) == s, F.col("l"))).alias(f"lineup_{s}") for s in "ab"))
    full = (F.coalesce(F.size("lineup_a"), F.lit(0)) == size) & (F.coalesce(F.size("lineup_b"), F.lit(0)) == size)
    return wide.select(key, *(F.when(full, F.col(f"lineup_{s}")).alias(f"lineup_{s}") for s in "ab"))


def paired_rows(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys with exactly two rows, side by side: field_1 and field_2 in ``order``."""
    row = F.struct(*order, *(c for c in fields if c not in order))
    both = df.groupBy(key).agg(F.count("*").alias("n"), F.min(row).alias("x"), F.max(row).alias("y")).where("n = 2")
    return both.select(key, *(F.col(f"{s}.{c}").alias(f"{c}_{i}") for c in fields for i, s in ((1, "x"), (2, "y"))))


def opponents(df: DataFrame, keys: Sequence[str], team: str, opponent: str, fields: Sequence[str]) -> DataFrame:
    """Each team's row with the fields of its opponent's row of the same game."""
    other = df.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(team).alias("_team"), *(F.col(c).alias(f"opponent_{c}") for c in fields))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(opponent) == F.col("_team")])
    return df.join(other, on).select(*df.columns, *(f"opponent_{c}" for c in fields))


def lookup(df: DataFrame, dims: Sequence[DataFrame], on: Sequence[str], value: str, default) -> DataFrame:
    """``value`` from the first of several lookup tables that has the key, else ``default``."""
    out, names = df, []
    for i, dim in enumerate(dims):
        one = dim.groupBy(*on).agg(F.min(value).alias(f"_v{i}"))
        out, names = out.join(one, list(on), "left"), [*names, F.col(f"_v{i}")]
    return out.select(*df.columns, F.coalesce(*names, F.lit(default)).alias(value))


def rejects(df: DataFrame, reasons: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that fail no check, and the others with the first check they fail as ``reject_reason``."""
    why = F.lit(None).cast("string")
    for name, bad in reversed(reasons):
        why = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(why)
    marked = df.withColumn("reject_reason", why)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """All feeds by column name; columns a feed lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def contains_all(c: Column, query: str) -> Column:
    """Whether a text holds every word of a query, in any case."""
    words = query.lower().split()
    return reduce(lambda a, b: a & b, (F.lower(c).contains(w) for w in words), F.lit(True))


def with_player_groups(scores: DataFrame, players: DataFrame, on: Sequence[str], team_a: str, team_b: str, team: str, fields: Sequence[str], size: int = 5) -> DataFrame:
    """Score rows with the players of both teams as arrays players_a and players_b, where both teams have at least ``size``.

    Players are grouped once by ``on`` and team and joined twice; a group is one team's players of one game.
    """
    groups = players.groupBy(*on, team).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct(*fields))).alias("_players")).where(F.col("_n") >= size)
    out = scores
    for side, name in (("a", team_a), ("b", team_b)):
        mine = groups.select(*(F.col(k).alias(f"_{k}") for k in on), F.col(team).alias("_team"), F.col("_players").alias(f"players_{side}"))
        same = reduce(lambda x, y: x & y, (F.col(k) == F.col(f"_{k}") for k in on), F.col(name) == F.col("_team"))
        out = out.join(mine, same).drop(*(f"_{k}" for k in on), "_team")
    return out


def inner_merge(facts: DataFrame, other: DataFrame, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Facts with the sums of ``measures`` over the rows of ``other`` that share their key; facts without any go."""
    return facts.join(other.groupBy(*on).agg(*(F.sum(m).alias(m) for m in measures)), list(on))

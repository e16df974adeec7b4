"""Point-in-time history: what a key had done strictly before a period.

Every operator first sums each (key, period), then runs a RANGE frame that ends one period earlier over those few rows, so
a key's history costs one shuffle of pre-aggregated rows, however many facts it has, and rows of one period never see
each other. Periods are integers (years); gaps are handled by the frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: Sequence[str], period: str, window: int | None):
    first = Window.unboundedPreceding if window is None else -window
    return Window.partitionBy(*keys).orderBy(period).rangeBetween(first, -1)


def running_stats(facts: DataFrame, keys: Sequence[str], period: str, stats: Sequence[str]) -> DataFrame:
    """n and the sum of each stat by (keys, period): a mergeable partial result."""
    return facts.where(F.col(period).isNotNull()).groupBy(*keys, period).agg(F.count("*").alias("n"), *(F.sum(F.coalesce(s, F.lit(0.0))).alias(f"sum_{s}") for s in stats))


def merge_stats(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial stats summed over periods."""
    return partials.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in partials.columns if c == "n" or c.startswith("sum_")))


def prior_stats(facts: DataFrame, keys: Sequence[str], period: str, stats: Sequence[str], window: int | None = None) -> DataFrame:
    """For every (keys, period) that occurs: n and sums over earlier periods (the last ``window`` of them, if given)."""
    return prior_sums(running_stats(facts, keys, period, stats), keys, period, stats, window)


def prior_sums(part: DataFrame, keys: Sequence[str], period: str, stats: Sequence[str], window: int | None = None) -> DataFrame:
    """``prior_stats`` of sums by (keys, period) that are there already."""
    w = _before(keys, period, window)
    sums = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"prior_{c}") for c in ("n", *(f"sum_{s}" for s in stats))]
    return part.select(*keys, period, *sums)


def global_prior_mean(facts: DataFrame, period: str, stats: Sequence[str]) -> DataFrame:
    """Means over all facts of earlier periods, one row a period (few rows, so the frame has no partition)."""
    part = running_stats(facts, [], period, stats)
    w = Window.orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    n = F.sum("n").over(w)
    return part.select(period, *(F.coalesce(F.sum(f"sum_{s}").over(w) / n, F.lit(0.0)).alias(f"global_{s}") for s in stats))


def shrunk(total: Column, n: Column, prior: Column, k: float = 5.0) -> Column:
    """(total + k * prior) / (n + k), and 0 where there is no history: an unseen key is not given the prior."""
    return F.when(n > 0, (total + k * prior) / (n + k)).otherwise(0.0)


def shrunk_history(facts: DataFrame, keys: Sequence[str], period: str, stats: Sequence[str], k: float = 5.0, window: int | None = None) -> DataFrame:
    """prior_n and the shrunk prior mean of each stat by (keys, period)."""
    return shrunk_sums(prior_stats(facts, keys, period, stats, window), global_prior_mean(facts, period, stats), keys, period, stats, k)


def shrunk_sums(prior: DataFrame, world: DataFrame, keys: Sequence[str], period: str, stats: Sequence[str], k: float = 5.0) -> DataFrame:
    """``shrunk_history`` of prior sums and the periods' ``global_prior_mean``."""
    world = F.broadcast(world)  # one row a period
    return prior.join(world, period).select(*keys, period, "prior_n", *(shrunk(F.col(f"prior_sum_{s}"), F.col("prior_n"), F.col(f"global_{s}"), k).alias(f"{s}_mean") for s in stats))


def state_before(facts: DataFrame, keys: Sequence[str], period: str, stats: Sequence[str], cutoff: int, k: float = 5.0) -> DataFrame:
    """Serving: the shrunk history of every key as of ``cutoff``, which needs no row of that period."""
    past = facts.where(F.col(period) < cutoff)
    mine = merge_stats(running_stats(past, keys, period, stats), keys)
    world = past.agg(*(F.coalesce(F.avg(F.coalesce(s, F.lit(0.0))), F.lit(0.0)).alias(f"global_{s}") for s in stats))
    return mine.crossJoin(F.broadcast(world)).select(*keys, F.col("n").alias("prior_n"), *(shrunk(F.col(f"sum_{s}"), F.col("n"), F.col(f"global_{s}"), k).alias(f"{s}_mean") for s in stats))


def outcome_history(outcomes: DataFrame, keys: Sequence[str], period: str, won: str = "won", margin: str = "margin") -> DataFrame:
    """prior_n, success rate (0.5 without history) and mean margin (0.0) by (keys, period); rows without an outcome don't count."""
    known = outcomes.withColumns({"_g": F.col(won).isNotNull().cast("int"), "_w": F.coalesce(F.col(won), F.lit(0)), "_m": F.when(F.col(won).isNotNull(), F.coalesce(F.col(margin), F.lit(0.0))).otherwise(0.0)})
    part = known.where(F.col(period).isNotNull()).groupBy(*keys, period).agg(F.sum("_g").alias("g"), F.sum("_w").alias("w"), F.sum("_m").alias("m"))
    w = _before(keys, period, None)
    g = F.coalesce(F.sum("g").over(w), F.lit(0))
    return part.select(*keys, period, g.alias("prior_n"), F.when(g > 0, F.sum("w").over(w) / g).otherwise(0.5).alias("success"), F.when(g > 0, F.sum("m").over(w) / g).otherwise(0.0).alias("margin"))


def outcome_history_sets(outcomes: DataFrame, sets: Sequence[Sequence[str]], period: str, won: str = "won", margin: str = "margin") -> DataFrame:
    """``outcome_history`` of several key sets from one scan and one shuffle by grouping sets.

    Rows carry all keys (null where a set lacks one) and ``key_set``, the set's number.
    """
    names = list(dict.fromkeys(k for s in sets for k in s))
    rows = outcomes.where(F.col(period).isNotNull() & F.col(won).isNotNull())
    number = F.lit(None).cast("int")
    for i, s in enumerate(sets):
        number = F.when(F.grouping_id() == sum(1 << (len(names) - j) for j, k in enumerate(names) if k not in s), i).otherwise(number)
    part = rows.groupingSets([[*map(F.col, s), F.col(period)] for s in sets], *map(F.col, names), F.col(period)).agg(number.alias("key_set"), F.count("*").alias("g"), F.sum(won).alias("w"), F.sum(F.coalesce(margin, F.lit(0.0))).alias("m"))
    w = _before(["key_set", *names], period, None)
    g = F.coalesce(F.sum("g").over(w), F.lit(0))
    return part.select("key_set", *names, period, g.alias("prior_n"), F.when(g > 0, F.sum("w").over(w) / g).otherwise(0.5).alias("success"), F.when(g > 0, F.sum("m").over(w) / g).otherwise(0.0).alias("margin"))


def last_n_form(outcomes: DataFrame, keys: Sequence[str], period: str, order: Sequence[str], sizes: Sequence[int] = (5, 10), won: str = "won", margin: str = "margin") -> DataFrame:
    """Mean outcome and margin of a key's last games of earlier periods, for each of ``sizes``; 0.5 and 0.0 without any.

    Each period keeps at most the largest size of its own last games, ranked by ``order``; the newest of all earlier
    periods are then cut from those short lists.
    """
    most = max(sizes)
    known = outcomes.where(F.col(period).isNotNull())
    ranked = known.where(F.col(won).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, period).orderBy(*(F.desc(c) for c in order)))).where(F.col("_r") <= most)
    item = F.struct((-F.col("_r")).alias("r"), F.col(won).cast("double").alias("w"), F.coalesce(F.col(margin), F.lit(0.0)).cast("double").alias("m"))
    lists = ranked.groupBy(*keys, period).agg(F.collect_list(item).alias("games"))  # at most ``most`` a period
    periods = known.select(*keys, period).distinct().join(lists, [*keys, period], "left")
    with_games = periods.withColumn("_has", F.col("games").isNotNull().cast("int"))
    seq = with_games.withColumn("_k", F.sum("_has").over(Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)))
    some = seq.where("_has = 1").select(*keys, period, F.array_sort("games").alias("games"))
    chained = some.withColumn("past", F.flatten(F.collect_list("games").over(Window.partitionBy(*keys).orderBy(period).rowsBetween(-most + 1, 0))))
    chained = chained.withColumn("past", F.slice(F.reverse("past"), 1, most)).select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(period)).alias("_k"), "past")
    out = seq.withColumn("_k", F.coalesce("_k", F.lit(0)).cast("int")).join(chained, [*keys, "_k"], "left")
    cols = []
    for n in sizes:
        head = F.slice(F.coalesce("past", F.array().cast("array<struct<r:int,w:double,m:double>>")), 1, n)
        size = F.size(head)
        cols.append(F.when(size > 0, F.aggregate(head, F.lit(0.0), lambda a, x: a + x["w"]) / size).otherwise(0.5).alias(f"form{n}"))
        cols.append(F.when(size > 0, F.aggregate(head, F.lit(0.0), lambda a, x: a + x["m"]) / size).otherwise(0.0).alias(f"form{n}_margin"))
    return out.select(*keys, period, *cols)


def last_roster(appearances: DataFrame, team: str, period: str, match: str, player: str) -> DataFrame:
    """The roster (sorted array) of a team's latest match in earlier periods, by (team, period)."""
    rosters = appearances.where(F.col(period).isNotNull()).groupBy(team, period, match).agg(F.array_sort(F.collect_set(player)).alias("roster"))  # one match
    return latest_roster(rosters, team, period, match)


def latest_roster(rosters: DataFrame, team: str, period: str, match: str) -> DataFrame:
    """``last_roster`` of rosters by (team, period, match) that are there already."""
    latest = rosters.groupBy(team, period).agg(F.max_by("roster", match).alias("roster"))
    w = Window.partitionBy(team).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    return latest.select(team, period, F.last("roster", ignorenulls=True).over(w).alias("previous_roster"))


def overlap_with(appearances: DataFrame, previous: DataFrame, team: str, period: str, match: str, player: str) -> DataFrame:
    """The share of a match's roster that is in its team's ``previous_roster`` (by team and period); 0 without one."""
    now = appearances.groupBy(team, period, match).agg(F.collect_set(player).alias("roster"))
    return now.join(previous, [team, period], "left").select(team, period, match, shared_part(F.col("roster"), F.col("previous_roster")).alias("overlap"))


def shared_part(roster: Column, previous: Column) -> Column:
    """The share of ``roster`` that is in ``previous``; 0 where that is null."""
    shared = F.size(F.array_intersect(roster, F.coalesce(previous, F.slice(roster, 1, 0))))
    return shared / F.greatest(F.size(roster), F.lit(1))


def roster_overlap(appearances: DataFrame, team: str, period: str, match: str, player: str) -> DataFrame:
    """The share of a match's roster that played the team's latest earlier match; 0 without one."""
    return overlap_with(appearances, last_roster(appearances, team, period, match, player), team, period, match, player)


#: The most players of one side of one match; a longer lineup is an error, as its pairs grow with its square.
MOST_PLAYERS = 16


def pairs_of(appearances: DataFrame, scope: Sequence[str], period: str, match: str, side: str, player: str) -> DataFrame:
    """Each pair p, q of different players of one side of one match, with scope, period, match and side."""
    known = appearances.where(F.col(period).isNotNull())
    rosters = known.groupBy(*scope, period, match, side).agg(F.array_sort(F.collect_set(player)).alias("r"))  # one side of one match
    return roster_pairs(rosters, scope, period, match, side)


def roster_pairs(rosters: DataFrame, scope: Sequence[str], period: str, match: str, side: str) -> DataFrame:
    """``pairs_of`` rosters: one row a match and side, with its sorted distinct players in ``r``."""
    long = F.raise_error(F.concat(F.lit(f"over {MOST_PLAYERS} players of one side in match "), F.col(match).cast("string")))
    rosters = rosters.where(F.when(F.size("r") <= MOST_PLAYERS, F.lit(True)).otherwise(long.cast("boolean")))
    after = F.transform("r", lambda p, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda q: F.struct(p.alias("p"), q.alias("q"))))
    return rosters.select(*scope, period, match, side, F.inline(F.flatten(after)))


def pair_means(each: DataFrame, match: str, side: str) -> DataFrame:
    """synergy, the mean of ``met`` over a side's pairs, and known, the share of them that met."""
    return each.groupBy(match, side).agg(F.avg("met").alias("synergy"), F.avg(F.when(F.col("met") > 0, 1.0).otherwise(0.0)).alias("known"))


def pair_history(appearances: DataFrame, scope: Sequence[str], period: str, match: str, side: str, player: str) -> DataFrame:
    """For each (match, side): the mean number of earlier-period meetings over its pairs of different players, and the share of
    pairs that met. Pairs are counted within ``scope`` (empty: anywhere).

    Players of one side of one match form a small set, so its pairs are few; keys of pairs are summed before the frame.
    """
    return pair_means_before(pairs_of(appearances, scope, period, match, side, player), scope, period, match, side)


def pair_means_before(pairs: DataFrame, scope: Sequence[str], period: str, match: str, side: str) -> DataFrame:
    """``pair_history`` of pairs that are there already."""
    met = pairs.groupBy(*scope, "p", "q", period).agg(F.count("*").alias("n"))
    w = _before([*scope, "p", "q"], period, None)
    prior = met.select(*scope, "p", "q", period, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("met"))
    return pair_means(pairs.join(prior, [*scope, "p", "q", period]), match, side)


def latest_before(facts: DataFrame, keys: Sequence[str], period: str, value: str, order: str) -> DataFrame:
    """The last value (by ``order``) of the latest earlier period, by (keys, period)."""
    last = facts.groupBy(*keys, period).agg(F.max_by(value, order).alias("_v"))
    w = _before(keys, period, None)
    return last.select(*keys, period, F.last("_v", ignorenulls=True).over(w).alias(f"previous_{value}"))

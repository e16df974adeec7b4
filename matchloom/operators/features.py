"""Feature contracts and the wide projections that fill them.

A contract is a list of column names generated from the dimensions (maps, agents, roles), never a literal list. Wide
frames are built in single selects.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("a", "b")
# The names that make up the contracts.
STATS = ("kd", "kast", "adr", "apr", "fkpr", "fdpr", "clutch")
RELIABILITY = (
    "known_player_ratio", "low_sample_player_ratio", "map_agent_games_mean", "map_agent_known_ratio", "player_agent_games_mean",
    "player_agent_known_ratio", "history_coverage_mean",
)
TEAM = ("team_games", "team_success", "team_margin_mean", "team_map_games", "team_map_success", "team_map_margin_mean", "team_event_games", "team_event_success")
FORM = ("team_form5_success", "team_form5_margin_mean", "team_form10_success", "team_form10_margin_mean")
ROSTER = ("roster_pair_games_mean", "roster_pair_known_ratio", "roster_prev_overlap_ratio")
COMP = ("comp_games", "comp_success", "comp_low_sample_ratio")
#: name -> the two bases whose product it is
PRODUCTS = {
    "prior_kd_x_history_coverage": ("prior_kd_mean", "history_coverage_mean"),
    "player_agent_kd_x_known_ratio": ("player_agent_kd_mean", "player_agent_known_ratio"),
    "agent_map_fit_x_known_ratio": ("agent_map_fit_sum", "map_agent_known_ratio"),
}


def key(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def sided(bases: Sequence[str], diff: bool = True) -> list[str]:
    return [f"{s}_{b}" for b in bases for s in (*SIDES, *(("diff",) if diff else ()))]


def one_hot_names(prefix: str, values: Sequence[str]) -> list[str]:
    return [f"{prefix}_{key(v)}" for v in values]


def count_names(kind: str, values: Sequence[str]) -> list[str]:
    return sided([f"{kind}_{key(v)}_count" for v in values])


def history_bases(scope: str, stats: Sequence[str]) -> list[str]:
    return [f"{scope}_{s}_mean" for s in stats]


def baseline_contract(maps: Sequence[str], roles: Sequence[str], agents: Sequence[str]) -> list[str]:
    """Map one-hots, role and agent counts, prior means with games, synergy, and map-agent and player-agent means."""
    prior = ["prior_games_mean", *history_bases("prior", STATS)]
    return [
        *one_hot_names("map", maps), *count_names("role", roles), *count_names("agent", sorted(map(key, agents))), *sided(prior), *sided(["synergy_mean"]),
        *sided(history_bases("map_agent", STATS)), *sided(history_bases("player_agent", STATS)),
    ]


def advanced_contract(maps: Sequence[str]) -> list[str]:
    """The chronological contract: no composition counts and no clutch; reliability, team, form, roster and composition context."""
    stats = [s for s in STATS if s != "clutch"]
    return [
        *one_hot_names("map", maps), *sided(["prior_games_mean", *history_bases("prior", stats)]), *sided(["synergy_mean"]),
        *sided(history_bases("map_agent", stats)), *sided(history_bases("player_agent", stats)), "map_agent_history_missing", "player_agent_history_missing",
        "map_atk_adv", "a_agent_map_fit_sum", "b_agent_map_fit_sum", "diff_agent_map_fit", *sided(["role_balance"], diff=False),
        *sided(["has_controller", "has_initiator", "double_duelist"], diff=False), *sided(["comp_meta_wr"]), *sided(["max_prior_kd", "std_prior_kd"]),
        *sided(RELIABILITY), *sided(TEAM), *sided(FORM), *sided(ROSTER), *sided(COMP), *sided(tuple(PRODUCTS)),
    ]


def family_names(values: Sequence[str]) -> list[str]:
    """a_, b_ and diff_ of each agent or role."""
    return sided([key(v) for v in values])


def check_contract(columns: Sequence[str], size: int) -> list[str]:
    """``columns`` if they are ``size`` different names; an error otherwise."""
    if len(columns) != size or len(set(columns)) != size:
        raise RuntimeError(f"the contract has {len(columns)} columns ({len(set(columns))} different), not {size}")
    return list(columns)


def one_hot(c: Column, prefix: str, values: Sequence[str]) -> list[Column]:
    k = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return [F.coalesce((k == key(v)).cast("double"), F.lit(0.0)).alias(f"{prefix}_{key(v)}") for v in values]


def side_counts(players: DataFrame, match: str, side: str, column: str, values: Sequence[str]) -> DataFrame:
    """a, b and diff counts of each value by match, from one conditional aggregation."""
    k = F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]", "")
    n = players.groupBy(match).agg(*(F.count_if((F.col(side) == s) & (k == key(v))).cast("double").alias(f"{s}_{key(v)}_count") for v in values for s in SIDES))
    return n.select(match, *(c for v in values for b in [f"{key(v)}_count"] for c in (f"a_{b}", f"b_{b}", (F.col(f"a_{b}") - F.col(f"b_{b}")).alias(f"diff_{b}"))))


def spread_sides(df: DataFrame, match: str, side: str, bases: Sequence[str], default: float = 0.0) -> DataFrame:
    """One row a match with a_, b_ and diff_ of each base from one row a side; what is missing is ``default``."""
    wide = df.groupBy(match).agg(*(F.coalesce(F.max(F.when(F.col(side) == s, F.col(b).cast("double"))), F.lit(default)).alias(f"{s}_{b}") for b in bases for s in SIDES))
    return wide.select(match, *(c for b in bases for c in (f"a_{b}", f"b_{b}", (F.col(f"a_{b}") - F.col(f"b_{b}")).alias(f"diff_{b}"))))


def with_diffs(df: DataFrame, bases: Sequence[str]) -> DataFrame:
    return df.select("*", *((F.coalesce(F.col(f"a_{b}"), F.lit(0.0)) - F.coalesce(F.col(f"b_{b}"), F.lit(0.0))).alias(f"diff_{b}") for b in bases))


def interactions(df: DataFrame, products: dict[str, tuple[str, str]]) -> DataFrame:
    """name -> (x, y): the product of both bases for each side, and its diff."""
    side = {f"{s}_{n}": F.coalesce(F.col(f"{s}_{x}"), F.lit(0.0)) * F.coalesce(F.col(f"{s}_{y}"), F.lit(0.0)) for n, (x, y) in products.items() for s in SIDES}
    return df.select("*", *(c.alias(n) for n, c in side.items()), *((side[f"a_{n}"] - side[f"b_{n}"]).alias(f"diff_{n}") for n in products))


def cold_start(df: DataFrame, bases: Sequence[str], name: str) -> DataFrame:
    """1 where every a_ and b_ value of ``bases`` is zero or missing."""
    every = reduce(lambda x, y: x & y, (F.coalesce(F.col(f"{s}_{b}"), F.lit(0.0)) == 0 for b in bases for s in SIDES))
    return df.withColumn(name, every.cast("double"))


def project(df: DataFrame, contract: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the contract's columns in its order as doubles; absent columns and unreadable values are 0."""
    have = set(df.columns)
    return df.select(*keep, *((F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in contract))


def nonzero_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mean of each column over its non-zero values, in one row; 0 without any."""
    return df.agg(*(F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0)).alias(c) for c in columns))


def impute_zeros(df: DataFrame, means: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zeros of ``columns`` replaced by ``means`` (one row, from the fitting split only). Zero is the mark of missing, so true zeros change too."""
    m = means.select(*(F.col(c).alias(f"_m_{c}") for c in columns))
    j = df.crossJoin(F.broadcast(m))
    return j.select(*(F.when(F.col(c) == 0, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def side_spread(df: DataFrame, match: str, side: str, value: str) -> DataFrame:
    """Mean, maximum and population deviation of a value by side."""
    return df.groupBy(match, side).agg(F.avg(value).alias(f"mean_{value}"), F.max(value).alias(f"max_{value}"), F.stddev_pop(value).alias(f"std_{value}"))


def coverage(df: DataFrame, match: str, side: str, games: str, low: int = 5) -> DataFrame:
    """The share of a side's players with any history, and with less than ``low`` games of it."""
    return df.groupBy(match, side).agg(F.avg((F.col(games) > 0).cast("double")).alias("history_coverage"), F.avg((F.col(games) < low).cast("double")).alias("low_history_ratio"))


# What names of columns that the match itself decides look like.
FORBIDDEN = (
    r"(^|_)score(_|$)",
    r"winner|result|round",
    r"(^|_)(acs|kills|deaths|assists|hs)($|_)",
    r"(^|_)team_[ab]($|_)",
    r"h2h|prior_wr|map_wr|recent5_wr",
    r"map_prior|agent_prior|recent5",
    r"atk_side|is_attacker",
    r"^[ab]_p[1-5]_",
)


def forbidden_names(columns: Sequence[str], patterns: Sequence[str] = FORBIDDEN) -> list[str]:
    """Columns whose names say that they come from the match itself."""
    found = re.compile("|".join(f"(?:{p})" for p in patterns))
    return [c for c in columns if found.search(c.lower())]


#: The nine groups that a model report puts features in, by the first pattern that fits; others are "other".
GROUPS = (
    ("player_agent", r"^(diff_|a_|b_)?player_agent_"), ("map_agent", r"^(diff_|a_|b_)?(map_agent_|agent_map_fit)"), ("player_prior", r"^(diff_|a_|b_)?(prior_|(max|std)_prior_kd$|(known|low_sample)_player_ratio$)"),
    ("team_history", r"^(diff_|a_|b_)?team_"), ("roster_history", r"^(diff_|a_|b_)?roster_"), ("comp_role", r"^(diff_|a_|b_)?(comp_|synergy_mean$|role_balance$|has_(controller|initiator)$|double_duelist$)"),
    ("history_reliability", r"history|_known_ratio$"), ("map_context", r"^map_|^(diff_|a_|b_)map_atk_adv$"),
)

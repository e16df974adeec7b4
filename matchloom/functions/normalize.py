"""Scalar normalisers as Column expressions: no UDFs, malformed values become null or a stated default."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits only; the join key for names that differ in case, spaces or slashes."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def clean_key(c: Column) -> Column:
    """Trimmed lower-case text; null, '' and 'nan' become ''."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isNull() | t.isin("", "nan"), "").otherwise(t)


def null_clean(c: Column, fallback: str | None = None) -> Column:
    """Trimmed text, or ``fallback`` for null, '' and 'nan' in any case."""
    t = F.trim(c.cast("string"))
    return F.when(t.isNull() | F.lower(t).isin("", "nan"), F.lit(fallback)).otherwise(t)


def to_double(c: Column, fallback: float | None = None) -> Column:
    """A lenient number: malformed, empty, 'nan' and infinite values become ``fallback``."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(fallback).cast("double")).otherwise(v)


def percent(c: Column) -> Column:
    """'75%' and '0.75' are both 0.75; values above one are divided by 100."""
    v = to_double(F.rtrim(F.trim(c.cast("string")), F.lit("%")))
    return F.when(v > 1, v / 100).otherwise(v)


def kill_ratio(kills: Column, deaths: Column, cap: float | None = None) -> Column:
    """kills / max(deaths, 1), at most ``cap``. Missing and empty parts count as none; a malformed one makes the ratio 0."""
    raw = [c.cast("string") for c in (kills, deaths)]
    k, d = (F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(to_double(c)) for c in raw)
    r = F.coalesce(k / F.greatest(d + F.lit(0.0), F.lit(1.0)), F.lit(0.0))
    r = F.when(k.isNull() | d.isNull(), F.lit(0.0)).otherwise(r)
    return F.least(r, F.lit(float(cap))) if cap is not None else r


def finite(c: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def year_and_source(event: Column, date: Column, patch_years: dict[int, int]) -> tuple[Column, Column]:
    """The year of a match and where it comes from: a year 2010-2029 in the event or date, else that of the date's patch."""
    found = F.regexp_extract(F.coalesce(event, F.lit("")), r"(20[12]\d)", 1).try_cast("int")
    dated = F.regexp_extract(F.coalesce(date, F.lit("")), r"(20[12]\d)", 1).try_cast("int")
    major = F.regexp_extract(F.coalesce(date, F.lit("")), r"Patch (\d+)\.\d+", 1).try_cast("int")
    patch = F.lit(None).cast("int")
    for number, year in patch_years.items():
        patch = F.when(major == number, year).otherwise(patch)
    named = F.coalesce(found, dated)
    return F.coalesce(named, patch), F.when(named.isNotNull(), "event").when(patch.isNotNull(), "patch").otherwise("unknown")


def date_quality(date: Column) -> Column:
    """iso for a full date, partial for one with a year only, missing otherwise."""
    d = F.coalesce(F.trim(date), F.lit(""))
    full = d.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(F.substring(d, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    return F.when(full, "iso").when(d.rlike(r"(19|20)\d{2}"), "partial").otherwise("missing")


def surrogate_key(*parts: Column, length: int = 16) -> Column:
    """A SHA-1 prefix of the parts joined by '|'; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, length)


def match_dedup_key(year: Column, team_a: Column, team_b: Column, map_name: Column, score_a: Column, score_b: Column) -> Column:
    """The same for both orders of sides: teams lower-cased and sorted, scores sorted."""
    a, b = F.lower(F.trim(team_a)), F.lower(F.trim(team_b))
    low, high = F.least(score_a, score_b).cast("int"), F.greatest(score_a, score_b).cast("int")
    return surrogate_key(year, F.least(a, b), F.greatest(a, b), map_name, low, high, length=24)


def pipe_list(c: Column, known: Column | None = None) -> Column:
    """The trimmed entries of a '|'-joined list; with ``known`` (an array of keys) only those whose key it holds."""
    items = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return items if known is None else F.filter(items, lambda x: F.array_contains(known, alnum_key(x)))


def score_pair(c: Column) -> Column:
    """'13 - 5' as struct(a, b); null unless there are exactly two numbers."""
    parts = F.split(c, "-")
    a, b = F.trim(F.get(parts, F.lit(0))).try_cast("int"), F.trim(F.get(parts, F.lit(1))).try_cast("int")
    return F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def composition_key(agents: Column) -> Column:
    """A '|'-joined sorted multiset."""
    return F.array_join(F.array_sort(agents), "|")


def entropy(counts: list[Column], scale: float = 2.0) -> Column:
    """Shannon entropy in bits over ``scale``; 0 where nothing is counted."""
    total = sum(counts[1:], counts[0]).cast("double")
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, sum(parts[1:], parts[0]) / scale).otherwise(0.0)


def vector_similarity(u: list[Column], v: list[Column], scale: float = 10.0) -> Column:
    """One minus the L1 distance over ``scale``."""
    d = [F.abs(a - b) for a, b in zip(u, v, strict=True)]
    return 1 - sum(d[1:], d[0]) / scale


def verdict(rate: Column, fit: float = 0.52, weak: float = 0.48) -> Column:
    return F.when(rate >= fit, "fit").when(rate <= weak, "weak").otherwise("ok")


def per_round(value: Column, rounds: Column) -> Column:
    """value / rounds; 0 where rounds are zero or anything is missing."""
    return F.coalesce(F.try_divide(value, F.nullif(rounds, F.lit(0))), F.lit(0.0))


def with_canonical(df: DataFrame, column: str, dim: DataFrame, raw: str, canonical: str, keep_unknown: bool = False) -> DataFrame:
    """Replace ``column`` by the canonical name that ``dim`` (raw, canonical) has for its key; unknown ones become null, or stay trimmed.

    ``dim`` is a dimension table; Spark broadcasts it when its size allows.
    """
    names = dim.select(alnum_key(F.col(raw)).alias("_key"), F.col(canonical).alias("_name")).groupBy("_key").agg(F.min("_name").alias("_name"))
    joined = df.join(names, alnum_key(F.col(column)) == F.col("_key"), "left")
    value = F.coalesce("_name", F.trim(F.col(column))) if keep_unknown else F.col("_name")
    return joined.select(*(value.alias(c) if c == column else F.col(c) for c in df.columns))


def resolved_role(agent_role: Column, raw_role: Column, roles: list[str]) -> Column:
    """The agent's role, else the raw role if it is one of ``roles``, else null."""
    raw = F.lower(F.trim(raw_role))
    return F.coalesce(agent_role, F.when(raw.isin([r.lower() for r in roles]), raw))


def winner(label: Column) -> Column:
    return F.when(label == 1, "A").when(label == 0, "B")


def side_won(side: Column, label: Column) -> Column:
    """1 if the side won, 0 if it lost, null for other sides or no label."""
    return F.when(side == "a", label).when(side == "b", 1 - label).cast("int")


def match_label(date: Column, map_name: Column, team_a: Column, team_b: Column, key: Column) -> Column:
    return F.concat_ws(" | ", null_clean(date), map_name, F.concat_ws(" vs ", team_a, team_b), key)


#: How a feature's name reads: the first rule that fits gives the label, {0} and {1} being its groups.
LABEL_RULES = (
    (r"(map|player)_agent_history_missing", "No {0}-agent history"),
    (r"map_atk_adv", "Map attack advantage"),
    (r"map_(?!agent_)(.+)", "Map: {0}"),
    (r"role_(.+)_count", "{0} picks"),
    (r"agent_other_count", "Other agents' picks"),
    (r"agent_(.+)_count", "{0} picks"),
    (r"prior_games_mean", "Players' mean games of earlier years"),
    (r"prior_(.+)_mean", "Players' mean {0} of earlier years"),
    (r"synergy_mean", "Mean games played together"),
    (r"(map|player)_agent_(.+)_mean", "Mean {1} of earlier years by {0} and agent"),
    (r"agent_map_fit(?:_sum)?", "Fit of agents to the map"),
    (r"role_balance", "Balance of roles"),
    (r"has_(.+)", "Has a {0}"),
    (r"double_(.+)", "Two or more {0}s"),
)


def feature_label(name: str, words: dict[str, str] | None = None) -> str:
    """A feature's name for people: the side or difference it is about, and its rule's text.

    ``words`` names maps, roles, agents and statistics; what it lacks is shown as it stands. A name without a rule is
    returned as it is.
    """
    words = words or {}
    side, rest = next(((t, name[len(p) :]) for p, t in (("a_", "Team A: "), ("b_", "Team B: "), ("diff_", "A over B: ")) if name.startswith(p)), ("", name))
    for pattern, text in LABEL_RULES:
        if m := re.fullmatch(pattern, rest):
            return side + text.format(*(words.get(g, g.replace("_", " ")) for g in m.groups()))
    return side + words[rest] if rest in words else name

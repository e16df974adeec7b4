"""Leakage and data-quality audits: each is one aggregation over the data and a small verdict."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.conform import allowed_source
from matchloom.operators.features import forbidden_names, key


def quality_report(matches: DataFrame, players: DataFrame, key: str, dedup_key: str, side: str, size: int, score_a: str, score_b: str, kd: str, cap: float = 10.0) -> DataFrame:
    """One row: matches, duplicates by each key, zero scores, clipped ratios and matches without full sides."""
    m = matches.agg(
        F.count("*").alias("n_matches"), (F.count("*") - F.count_distinct(key)).alias("duplicate_keys"), (F.count("*") - F.count_distinct(dedup_key)).alias("duplicate_dedup_keys"),
        F.count_if((F.col(score_a) == 0) | (F.col(score_b) == 0)).alias("zero_scores"),
    )
    p = players.agg(F.count("*").alias("n_players"), F.count_if(F.col(kd) > cap).alias("clipped"))
    sides = players.groupBy(key).agg(F.count_if(F.col(side) == "a").alias("a"), F.count_if(F.col(side) == "b").alias("b"))
    s = sides.agg(F.count_if((F.col("a") == size) & (F.col("b") == size)).alias("full"), F.count_if((F.col("a") != size) | (F.col("b") != size)).alias("incomplete"))
    return m.crossJoin(p).crossJoin(s)  # three rows of one


def perspective_flips(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """How many groups have more than one label."""
    return df.groupBy(*group).agg(F.count_distinct(label).alias("k")).agg(F.count_if(F.col("k") > 1).alias("flips"))


def case_collisions(df: DataFrame, name: str) -> DataFrame:
    """How many names are spelled in more than one case."""
    return df.groupBy(F.lower(F.trim(F.col(name))).alias("k")).agg(F.count_distinct(name).alias("n")).agg(F.count_if(F.col("n") > 1).alias("collisions"))


def disallowed_sources(df: DataFrame, prefixes: Sequence[str], source: str = "source") -> DataFrame:
    return df.where(~allowed_source(F.col(source), prefixes)).select(source).distinct()


def earliest_period_leak(df: DataFrame, period: str, history: Sequence[str]) -> DataFrame:
    """The largest absolute history value in the earliest period; anything but 0 is a leak."""
    first = df.groupBy(period).agg(F.max(F.greatest(*(F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in history), F.lit(0.0))).alias("largest"))
    return first.agg(F.min_by("largest", period).alias("largest"), F.min(period).alias("first_period"))


def trust_report(df: DataFrame, split: str, key: str, year: str, features: Sequence[str], expected: int, prefixes: Sequence[str], source: str = "source") -> dict:
    """Feature count, forbidden names, sources, key overlap and year order of a split frame, and the list of failures. One scan."""
    sides = ("train", "test")
    bad = ~allowed_source(F.col(source), prefixes)
    each = [F.count_if(F.col(split) == s).alias(f"n_{s}") for s in sides] + [f(F.when(F.col(split) == s, F.col(year))).alias(f"{n}_{s}") for s in sides for n, f in (("lo", F.min), ("hi", F.max))]
    keys = df.groupBy(key).agg(*each, F.count_if(bad).alias("bad"), F.array_sort(F.collect_set(F.when(bad, F.col(source)))).alias("sources"))
    one = keys.agg(
        *(F.sum(f"n_{s}").alias(f"n_{s}") for s in sides), *(f(f"{n}_{s}").alias(f"{n}_{s}") for s in sides for n, f in (("lo", F.min), ("hi", F.max))),
        F.sum("bad").alias("bad"), F.count_if((F.col("n_train") > 0) & (F.col("n_test") > 0)).alias("overlap"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    ).first()
    checks = {
        "feature_count": len(features) == expected,
        "no_forbidden_names": not forbidden_names(features),
        "sources_allowed": not one.bad,
        "no_overlap": not one.overlap,
        "train_before_test": bool(one.n_train and one.n_test and one.hi_train < one.lo_test),
    }
    return {
        "rows": {s: one[f"n_{s}"] or 0 for s in sides}, "years": {s: (one[f"lo_{s}"], one[f"hi_{s}"]) for s in sides}, "overlap": one.overlap, "bad_sources": list(one.sources or ()),
        "forbidden": forbidden_names(features), "checks": checks, "failures": [k for k, ok in checks.items() if not ok],
    }


def advanced_gate(trust: dict, model_features: dict[str, int], meta: dict, flips: int | None, collisions: int | None, auc: float | None, expected: int = 179, gate: float = 0.6182) -> dict:
    """The ten checks before a model is used, each passed, warned of, skipped or failed, and the verdict.

    ``trust`` is a ``trust_report``; ``model_features`` the input width of each member; ``meta`` has feature_contract,
    n_features and weights. ``flips`` and ``collisions`` are counts, None where there is no table to count in; collisions
    never fail. Trust failures and a low AUC both fail the gate, and are told apart.
    """
    weights = meta.get("weights")
    state = lambda ok: "passed" if ok else "failed"
    checks = {
        "feature_count": state(trust["checks"]["feature_count"]),
        "forbidden_names": state(trust["checks"]["no_forbidden_names"]),
        "split_overlap": state(trust["checks"]["no_overlap"]),
        "sources": state(trust["checks"]["sources_allowed"]),
        "model_width": state(all(n == expected for n in model_features.values())),
        "meta_contract": state(meta.get("feature_contract") == "advanced" and meta.get("n_features") == expected),
        "weights": state(isinstance(weights, (list, tuple)) and len(weights) == 3 and all(w > 0 for w in weights)),
        "perspective_flips": "skipped" if flips is None else state(flips == 0),
        "case_collisions": "skipped" if collisions is None else "passed" if collisions == 0 else "warned",
        "auc": state(auc is not None and auc >= gate),
    }
    trust_failures = [k for k, v in checks.items() if v == "failed" and k != "auc"]
    return {"checks": checks} | final_verdict(trust_failures, auc, gate)


def final_verdict(trust_failures: Sequence[str], auc: float | None, gate: float = 0.6182) -> dict:
    """Trust failures come before performance; the exit code is 0 only when both hold."""
    performance = [] if auc is not None and auc >= gate else ["auc_below_gate"]
    failures = [*trust_failures, *performance]
    verdict = "untrusted" if trust_failures else "insufficient" if performance else "passed"
    return {"verdict": verdict, "failures": failures, "exit_code": int(bool(failures))}


def valid_lineups(lineup_a: str = "lineup_a", lineup_b: str = "lineup_b", size: int = 5, agents: Sequence[str] | None = None) -> Column:
    """Both lineups have ``size`` entries, no player is there twice among all, and no agent twice on one side.

    Players are compared trimmed and in lower case. Agents are compared by letters and digits only, so that their
    spellings agree; with ``agents``, the known ones, others don't count.
    """
    name = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    players = F.concat(*(F.transform(side, lambda s: name(s["player"])) for side in (lineup_a, lineup_b)))
    ok = (F.size(lineup_a) == size) & (F.size(lineup_b) == size) & (F.size(F.array_distinct(players)) == F.size(players))
    for side in (lineup_a, lineup_b):
        keys = F.transform(side, lambda s: F.regexp_replace(name(s["agent"]), "[^a-z0-9]", ""))
        keys = F.filter(keys, lambda k: (k != "") if agents is None else k.isin(*(key(a) for a in agents)))
        ok = ok & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.coalesce(ok, F.lit(False))


def valid_requests(map_name: str = "map", year: str = "cutoff_year", lineup_a: str = "team_a", lineup_b: str = "team_b", size: int = 5) -> Column:
    """A map, a year of 2000 to 2099, and two lineups of ``size`` entries whose player and agent are not empty."""
    ok = F.col(map_name).isNotNull() & F.col(year).between(2000, 2099)
    for side in (lineup_a, lineup_b):
        ok = ok & (F.size(side) == size) & F.forall(side, lambda s: (F.length(s["player"]) > 0) & (F.length(s["agent"]) > 0))
    return F.coalesce(ok, F.lit(False))


def balance_warnings(duelists: Column, initiators: Column, controllers: Column, sentinels: Column) -> Column:
    """code and severity of the warnings that hold for a side's role counts, in a fixed order."""
    rules = [
        (controllers == 0, "no_controller", "high"), (sentinels >= 3, "too_many_sentinel", "high"), (duelists == 0, "no_duelist", "medium"),
        (initiators == 0, "no_initiator", "medium"), (duelists >= 4, "too_many_duelist", "low"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("code"), F.lit(v).alias("severity"))) for c, n, v in rules)))


#: What a family of features is called in a sentence, and how its difference reads.
SENTENCES = (
    ("prior_games", "games of earlier years", "{:.0f} games"),
    ("prior_kd", "mean K/D", "{:.2f}"),
    ("prior_adr", "damage a round", "{:.1f}"),
    ("prior_kast", "KAST", "{:.0%}"),
    ("synergy", "games played together", ""),
    ("map_agent", "experience with their agents on this map", ""),
    ("player_agent", "experience with their agents", ""),
)


def explanations(values: dict[str, float], ranked: Sequence[str], limit: int = 4) -> list[dict]:
    """Up to ``limit`` sentences (feature, text, magnitude) on what sets the sides apart.

    A difference of a game or more in earlier games leads. Then come the features of ``ranked``, most important first,
    one for each base, as far as a family of ``SENTENCES`` covers them and the sides differ.
    """
    base_of = lambda f: re.sub(r"^[ab]_|_mean$", "", f)
    gap = lambda base: values.get(f"a_{base}_mean", 0.0) - values.get(f"b_{base}_mean", 0.0)
    told = lambda f, text, d: {"feature": f, "text": f"Team {'A' if d > 0 else 'B'} {text}", "magnitude": abs(d)}
    out, seen = [], []
    lead = gap("prior_games")
    if abs(lead) >= 1:
        out.append(told("prior_games", f"leads by {abs(lead):.0f} games of earlier years", lead))
        seen.append("prior_games")
    for feature in ranked:
        base = base_of(feature)
        family = next((x for x in SENTENCES if x[0] in base), None)
        d = gap(base)
        if len(out) >= limit or any(base.startswith(b) for b in seen) or not family or abs(d) < 1e-9:
            continue
        by = f" by {family[2].format(abs(d))}" if family[2] else ""
        out.append(told(feature, f"leads in {family[1]}{by}", d))
        seen.append(base)
    return out


def explained_columns(ranked: Sequence[str]) -> list[str]:
    """The columns that ``explained_rows`` reads: both sides' means of the bases that a family of ``SENTENCES`` covers."""
    bases = dict.fromkeys(["prior_games", *(b for f in ranked if any(x[0] in (b := re.sub(r"^[ab]_|_mean$", "", f)) for x in SENTENCES))])
    return [f"{s}_{base}_mean" for base in bases for s in "ab"]


_TOLD = "array<struct<feature:string,leader:string,magnitude:double>>"


def explained_rows(frame: DataFrame, ranked: Sequence[str], limit: int = 4, name: str = "explanations") -> DataFrame:
    """``frame`` with ``name``: for each row up to ``limit`` items (feature, leader A or B, magnitude) as ``explanations`` has them.

    The families and bases of ``ranked`` are known beforehand, so that each row only folds its own few differences.
    """
    have = set(frame.columns)
    gap = lambda base: sum((sign * (F.coalesce(F.col(c), F.lit(0.0)) if (c := f"{s}_{base}_mean") in have else F.lit(0.0)) for s, sign in (("a", 1), ("b", -1))), F.lit(0.0))
    item = lambda f, base, d, ok: F.struct(F.lit(f).alias("feature"), F.lit(base).alias("base"), d.alias("d"), ok.alias("ok"))
    lead = gap("prior_games")
    items = [item("prior_games", "prior_games", lead, F.abs(lead) >= 1)]
    for f in ranked:
        base = re.sub(r"^[ab]_|_mean$", "", f)
        if any(x[0] in base for x in SENTENCES):
            items.append(item(f, base, gap(base), F.abs(gap(base)) >= 1e-9))

    def step(a, x):
        told = F.struct(x["feature"].alias("feature"), F.when(x["d"] > 0, "A").otherwise("B").alias("leader"), F.abs(x["d"]).alias("magnitude"))
        fresh = x["ok"] & (F.size(a["out"]) < limit) & ~F.exists(a["seen"], lambda b: F.startswith(x["base"], b))
        return F.struct(F.when(fresh, F.array_append(a["out"], told)).otherwise(a["out"]).cast(_TOLD).alias("out"), F.when(fresh, F.array_append(a["seen"], x["base"])).otherwise(a["seen"]).alias("seen"))

    start = F.struct(F.array().cast(_TOLD).alias("out"), F.array().cast("array<string>").alias("seen"))
    return frame.withColumn(name, F.aggregate(F.array(*items), start, step)["out"])


def vector_message(names: Sequence[str], mine: Sequence[Column], theirs: Sequence[Column], win_rate: Column) -> Column:
    """What sets a composition's role counts apart from the nearest one, and how often that one wins."""
    d = [(a - b).cast("int") for a, b in zip(mine, theirs, strict=True)]
    parts = [F.when(x > 0, F.format_string(f"%d more {n}", x)).when(x < 0, F.format_string(f"%d fewer {n}", -x)) for n, x in zip(names, d)]
    told = F.concat_ws(", ", *parts)
    head = F.when(told == "", F.lit("as the composition that wins most")).otherwise(told)
    return F.concat(head, F.format_string(" (nearest composition wins %.0f%%)", win_rate * 100))

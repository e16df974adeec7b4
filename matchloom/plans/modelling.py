"""Model queries: they train, so they have no SQL form; ``tests/test_modelling.py`` holds them to properties."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from matchloom.operators import features, history, metrics, ml, search, shap, splits
from matchloom.operators.search import Range
from matchloom.plans.bindings import M, matches
from matchloom.plans.registry import collector
from matchloom.sources.shared import shared_dir, written

QUERIES, ORACLES, query = collector()
FEATURES = ["prior_n", "success", "form5", "map_success"]
WEIGHT_GRID = [0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


def feature_rows(spark, sf):
    """Orders with strictly-before team features, and labels."""
    m = matches(spark, sf).where("label is not null")
    team = history.outcome_history(m, ["team"], "year", "label").select("team", "year", F.col("prior_n").cast("double"), "success")
    form = history.last_n_form(m, ["team"], "year", ["match_key"], won="label").select("team", "year", "form5")
    maps = history.outcome_history(m, ["map"], "year", "label").select("map", "year", F.col("success").alias("map_success"))
    return m.join(team, ["team", "year"]).join(form, ["team", "year"]).join(maps, ["map", "year"]).select("match_key", "team", "year", "label", *FEATURES)


def _split(spark, sf):
    """Written once: every fit and score of a query reads the table, none computes the history again."""
    return splits.chrono_split(written(feature_rows(spark, sf)), "year")


def _models(spark, sf):
    rows = _split(spark, sf)
    train = rows.where("split = 'train'")
    return ml.fit(ml.baseline_members(FEATURES, train.count()), train), rows.where("split = 'test'")


@query()
def o114_o126_soft_vote(spark, sf):
    models, test = _models(spark, sf)
    return ml.soft_vote(ml.member_probabilities(models, test), dict.fromkeys(models, 1.0)).select("match_key", "p", "predicted", "confidence")


@query()
def o115_tuned_baseline(spark, sf):
    """The mean AUC over five folds of teams of every setting of both baseline members."""
    train = _split(spark, sf).where("split = 'train'").select("team", "label", *FEATURES)
    return ml.tuned_baseline(train, FEATURES, "team")


def _advanced(spark, sf):
    """The three advanced members fitted on the years before the last training year, and that year's rows."""
    rows = _split(spark, sf).where("split = 'train'")
    last = rows.agg(F.max("year")).first()[0]
    fitting, validation = splits.fit_and_validation(rows, "year", last)
    return ml.fit(ml.advanced_members(FEATURES), fitting), validation


@query()
def o116_advanced_members(spark, sf):
    models, validation = _advanced(spark, sf)
    return ml.member_probabilities(models, validation).select("match_key", *(f"p_{m}" for m in models))


@query()
def o117_weight_search(spark, sf):
    """All weights of the full grid for the three advanced members, on the validation year."""
    models, validation = _advanced(spark, sf)
    scored = ml.member_probabilities(models, validation).select("label", *(f"p_{m}" for m in models))
    return metrics.weight_search(scored, [f"p_{m}" for m in models], "label", WEIGHT_GRID).select("weights", "auc")


@query()
def o122_permutation_importance(spark, sf):
    """The loss of AUC of the fitted vote for each feature, over ten permutations of it among all test rows."""
    models, test = _models(spark, sf)
    return ml.permutation_importance(ml.voter(models, dict.fromkeys(models, 1.0)), test, "match_key", FEATURES)


@query()
def o123_o124_importances(spark, sf):
    models, _ = _models(spark, sf)
    rows = ml.importances(models, FEATURES, dict.fromkeys(models, 1.0))
    return ml.group_importance(spark.createDataFrame(rows, "feature string, importance double"), [("form", "^form"), ("prior", "^prior|success")])


# Dimensions of the contracts' sizes: 13 maps, the last of which the advanced one leaves out, 4 roles and 28 agents.
_MAPS, _ROLES, _AGENTS = [f"map {i:02d}" for i in range(13)], ["duelist", "initiator", "controller", "sentinel"], [f"agent {i:02d}" for i in range(28)]
_SIDES = "(VALUES (0, 'a_'), (1, 'b_'), (2, 'diff_')) s(j, side)"


def _block(contract: str, number: int, bases: str, sides: str = _SIDES) -> str:
    """SQL for one block: each base under every side."""
    return f"SELECT '{contract}' AS contract, {number} AS b, i, j, side || base AS name FROM (SELECT base, row_number() OVER () AS i FROM (SELECT unnest({bases}) AS base)), {sides}"


_PLAIN, _AB = "(SELECT 0 AS j, '' AS side)", "(VALUES (0, 'a_'), (1, 'b_')) s(j, side)"
_MEANS = "['prior_games_mean', 'prior_kd_mean', 'prior_kast_mean', 'prior_adr_mean', 'prior_apr_mean', 'prior_fkpr_mean', 'prior_fdpr_mean'{}]"
_SCOPED = "['{0}_kd_mean', '{0}_kast_mean', '{0}_adr_mean', '{0}_apr_mean', '{0}_fkpr_mean', '{0}_fdpr_mean'{1}]"
_BLOCKS = [
    _block("baseline", 0, "[format('map_map{:02d}', x) for x in range(13)]", _PLAIN), _block("baseline", 1, "['role_duelist_count', 'role_initiator_count', 'role_controller_count', 'role_sentinel_count']"),
    _block("baseline", 2, "[format('agent_agent{:02d}_count', x) for x in range(28)]"), _block("baseline", 3, _MEANS.format(", 'prior_clutch_mean'")), _block("baseline", 4, "['synergy_mean']"),
    _block("baseline", 5, _SCOPED.format("map_agent", ", 'map_agent_clutch_mean'")), _block("baseline", 6, _SCOPED.format("player_agent", ", 'player_agent_clutch_mean'")),
    _block("advanced", 0, "[format('map_map{:02d}', x) for x in range(12)]", _PLAIN), _block("advanced", 1, _MEANS.format("")), _block("advanced", 2, "['synergy_mean']"),
    _block("advanced", 3, _SCOPED.format("map_agent", "")), _block("advanced", 4, _SCOPED.format("player_agent", "")),
    _block("advanced", 5, "['map_agent_history_missing', 'player_agent_history_missing', 'map_atk_adv', 'a_agent_map_fit_sum', 'b_agent_map_fit_sum', 'diff_agent_map_fit', 'a_role_balance', 'b_role_balance']", _PLAIN),
    _block("advanced", 6, "['has_controller', 'has_initiator', 'double_duelist']", _AB), _block("advanced", 7, "['comp_meta_wr', 'max_prior_kd', 'std_prior_kd']"),
    _block("advanced", 8, "['known_player_ratio', 'low_sample_player_ratio', 'map_agent_games_mean', 'map_agent_known_ratio', 'player_agent_games_mean', 'player_agent_known_ratio', 'history_coverage_mean']"),
    _block("advanced", 9, "['team_games', 'team_success', 'team_margin_mean', 'team_map_games', 'team_map_success', 'team_map_margin_mean', 'team_event_games', 'team_event_success']"),
    _block("advanced", 10, "['team_form5_success', 'team_form5_margin_mean', 'team_form10_success', 'team_form10_margin_mean']"),
    _block("advanced", 11, "['roster_pair_games_mean', 'roster_pair_known_ratio', 'roster_prev_overlap_ratio', 'comp_games', 'comp_success', 'comp_low_sample_ratio']"),
    _block("advanced", 12, "['prior_kd_x_history_coverage', 'player_agent_kd_x_known_ratio', 'agent_map_fit_x_known_ratio']"),
]


@query(f"SELECT contract, CAST(row_number() OVER (PARTITION BY contract ORDER BY b, i, j) - 1 AS INTEGER) AS position, name AS column_name FROM ({' UNION ALL '.join(_BLOCKS)})")
def o147_contract_columns(spark, sf):
    """The generated baseline and advanced contracts over 13 maps, 4 roles and 28 agents."""
    base = features.check_contract(features.baseline_contract(_MAPS, _ROLES, _AGENTS), 178)
    adv = features.check_contract(features.advanced_contract(_MAPS[:12]), 179)
    return spark.createDataFrame([("baseline", i, c) for i, c in enumerate(base)] + [("advanced", i, c) for i, c in enumerate(adv)], "contract string, position int, column_name string")


#: The cells of a model are few rows of much work, so they are dealt to this many tasks.
EXPLAIN_TASKS = 12


@query()
def o125_shap_top20(spark, sf):
    """The features of the largest mean absolute Shapley values of each advanced member, over all rows of the validation year."""
    models, validation = _advanced(spark, sf)
    out = []
    for name, model in models.items():
        leaves, expected = shap.explainer(model)
        rows = shap.explained(shap.cells(validation, FEATURES, leaves).repartition(EXPLAIN_TASKS), FEATURES, leaves, expected)
        out.append(shap.mean_absolute(rows, FEATURES, times="n").select(F.lit(name).alias("member"), "feature", "mean_abs_shap"))
    return reduce(lambda a, b: a.unionByName(b), out)


#: A tree of fixed thresholds over matches; its rows are counted from the data, so SQL can follow its Shapley values.
_FIXED_TREE = {"margin": 150_000.0, "year": 1995.0, "values": (0.2, 0.5, 0.9)}


def _fixed_nodes(rows) -> pd.DataFrame:
    """Node table of: margin <= t ? (year <= u ? v0 : v1) : v2, with the rows of ``rows`` that reach each node."""
    low = F.col("margin") <= _FIXED_TREE["margin"]
    early = low & (F.col("year") <= _FIXED_TREE["year"])
    n = rows.agg(F.count("*").alias("n"), F.count_if(low).alias("low"), F.count_if(early).alias("early")).first()
    v = _FIXED_TREE["values"]
    names = ["tree", "weight", "id", "left", "right", "feature", "threshold", "rows", "value", "categories", "arity"]
    nodes = [(0, 1.0, 0, 1, 2, 0, _FIXED_TREE["margin"], n.n, 0.0), (0, 1.0, 1, 3, 4, 1, _FIXED_TREE["year"], n.low, 0.0), (0, 1.0, 2, -1, -1, -1, None, n.n - n.low, v[2]), (0, 1.0, 3, -1, -1, -1, None, n.early, v[0]), (0, 1.0, 4, -1, -1, -1, None, n.low - n.early, v[1])]
    return pd.DataFrame([(*r, None, -1) for r in nodes], columns=names).astype({"categories": object})


@query(
    "WITH "
    + M
    + """,
b AS (SELECT match_key, (margin <= 150000)::INT AS low, (year <= 1995)::INT AS early FROM m),
z AS (SELECT avg(low) AS zl, sum(low * early) / sum(low) AS ze FROM b),
-- Expected values where neither, one or both of the features are given; a Shapley value is the mean of its gain in both orders.
f AS (SELECT match_key, ze * 0.2 + (1 - ze) * 0.5 AS inner_mean, CASE early WHEN 1 THEN 0.2 ELSE 0.5 END AS inner_given, low, zl FROM b, z),
g AS (SELECT match_key, zl * inner_mean + (1 - zl) * 0.9 AS none, CASE low WHEN 1 THEN inner_mean ELSE 0.9 END AS only_margin,
  zl * inner_given + (1 - zl) * 0.9 AS only_year, CASE low WHEN 1 THEN inner_given ELSE 0.9 END AS whole FROM f)
SELECT match_key, round((only_margin - none + whole - only_year) / 2, 9) AS shap_margin, round((only_year - none + whole - only_margin) / 2, 9) AS shap_year FROM g"""
)
def o125_fixed_tree_shap(spark, sf):
    """The Shapley values of every match under a tree of fixed thresholds."""
    rows = matches(spark, sf).select("match_key", "margin", F.col("year").cast("double").alias("year"))
    leaves, expected = shap.leaves_of(_fixed_nodes(rows))
    s = shap.explained(rows, ["margin", "year"], leaves, expected)
    return s.select("match_key", F.round(F.col("shap")[0], 9).alias("shap_margin"), F.round(F.col("shap")[1], 9).alias("shap_year"))


def _linear(rows):
    return rows.withColumn("p", 3 * F.col("margin") - 100_000 * F.col("year") + 50 * F.col("team"))


@query(
    "WITH "
    + M
    + """,
b AS (SELECT match_key, label, margin, CAST(year AS DOUBLE) AS year, CAST(team AS DOUBLE) AS team FROM m WHERE label IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CAST(('0x' || substr(sha1(concat(CAST(match_key AS VARCHAR), '|', CAST(seed AS VARCHAR))), 1, 15)) AS BIGINT), match_key) AS n
  FROM b, (SELECT unnest(range(42, 53)) AS seed)),
d AS (SELECT t.seed - 42 AS repeat, feature, t.label, CASE feature WHEN 'margin' THEN g.margin ELSE t.margin END AS margin, CASE feature WHEN 'year' THEN g.year ELSE t.year END AS year,
  CASE feature WHEN 'team' THEN g.team ELSE t.team END AS team FROM z t JOIN z g ON g.seed = t.seed + 1 AND g.n = t.n, (VALUES ('margin'), ('year'), ('team')) f(feature)
  UNION ALL SELECT -1, '', label, margin, year, team FROM b),
s AS (SELECT feature, repeat, label, 3 * margin - 100000 * year + 50 * team AS p FROM d),
r AS (SELECT *, rank() OVER (PARTITION BY feature, repeat ORDER BY p) + (count(*) OVER (PARTITION BY feature, repeat, p) - 1) / 2.0 AS mid FROM s),
a AS (SELECT feature, repeat, (sum(mid) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc FROM r GROUP BY feature, repeat)
SELECT feature, round(avg(w.auc - a.auc), 9) AS importance, round(stddev_pop(w.auc - a.auc), 9) AS deviation FROM a, (SELECT auc FROM a WHERE repeat < 0) w WHERE repeat >= 0 GROUP BY feature"""
)
def o122_linear_permutation(spark, sf):
    """The loss of AUC of a fixed linear score for each of its features, over ten permutations of it among all matches."""
    rows = written(matches(spark, sf).where("label is not null").select("match_key", "label", "margin", F.col("year").cast("double").alias("year"), F.col("team").cast("double").alias("team")))
    found = ml.permutation_importance(_linear, rows, "match_key", ["margin", "year", "team"])
    return found.select("feature", F.round("importance", 9).alias("importance"), F.round("deviation", 9).alias("deviation"))


def _area(models, rows):
    """The AUC of the only member on ``rows``. They are scored once and the scores written, as an area reads them several times."""
    (name,) = models
    scored = written(ml.member_probabilities(models, rows).select("label", f"p_{name}"), even=False)
    return metrics.auc(scored, f"p_{name}", "label").first().auc


#: Trials of the query; the operator's own callers choose theirs.
SEARCH_TRIALS, SEARCH_STARTUP = 8, 4
SEARCH_SPACE = {"numTrees": Range(10, 40, whole=True), "maxDepth": Range(3, 8, whole=True), "minInstancesPerNode": Range(10, 150, whole=True), "featureSubsetShare": Range(0.25, 0.75)}


@query()
def o118_parameter_search(spark, sf):
    """Trials of the forest's parameters by a tree of Parzen estimators: AUC on the last training year, fitted on those before."""
    rows = _split(spark, sf).where("split = 'train'")
    last = rows.agg(F.max("year")).first()[0]
    fitting, validation = splits.fit_and_validation(rows, "year", last)

    def objective(params):
        whole = {k: int(v) for k, v in params.items() if SEARCH_SPACE[k].whole}
        member = {"rf": ml.advanced_members(FEATURES, rf=whole | {"featureSubsetStrategy": str(params["featureSubsetShare"])})["rf"]}
        return _area(ml.fit(member, fitting), validation)

    return search.report(search.Study(spark, shared_dir(spark), SEARCH_SPACE, startup=SEARCH_STARTUP).run(objective, SEARCH_TRIALS))

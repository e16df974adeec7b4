"""Explanations of whole frames against the plain function of one row; the nine groups of a report."""

import random
import re

from matchloom.operators import audit, features

RANKED = ["a_prior_kd_mean", "diff_team_games", "b_prior_kd_mean", "b_synergy_mean", "a_player_agent_kd_mean", "a_player_agent_adr_mean", "a_map_agent_kd_mean", "b_prior_games_mean"]


def test_rows_are_explained_as_one_by_one(spark):
    rng = random.Random(3)
    columns = [f"{s}_{b}_mean" for b in ("prior_games", "prior_kd", "synergy", "player_agent_kd", "player_agent_adr", "map_agent_kd") for s in "ab"]
    rows = [(i, *(rng.choice([None, 0.0, 0.5, 2.0, rng.random()]) for _ in columns)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in columns))
    for limit in (4, 2):
        for r in audit.explained_rows(df, RANKED, limit).collect():
            values = {c: r[c] or 0.0 for c in columns}
            want = [(x["feature"], x["text"][5], round(x["magnitude"], 9)) for x in audit.explanations(values, RANKED, limit)]
            assert [(x.feature, x.leader, round(x.magnitude, 9)) for x in r.explanations] == want


def test_groups_cover_the_advanced_contract():
    def group(name):
        return next((g for g, pattern in features.GROUPS if re.search(pattern, name)), "other")

    names = features.advanced_contract([f"m{i}" for i in range(12)])
    found = {n: group(n) for n in names}
    assert set(found.values()) == {g for g, _ in features.GROUPS} and len(features.GROUPS) == 8
    assert found["map_m3"] == "map_context" and found["diff_prior_kd_mean"] == "player_prior" and found["a_map_agent_known_ratio"] == "map_agent"
    assert found["map_atk_adv"] == "map_context" and found["a_history_coverage_mean"] == "history_reliability" and found["diff_agent_map_fit"] == "map_agent"
    assert group("unheard_of") == "other"

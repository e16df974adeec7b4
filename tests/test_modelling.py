from itertools import product

import pytest

from matchloom.operators import metrics, ml
from matchloom.plans import modelling

SF = "/root/testdata/sf0.001"


def test_weight_search_tries_the_whole_grid(spark):
    rows = modelling.QUERIES["o117_weight_search"](spark, SF).collect()
    assert {tuple(r.weights) for r in rows} == set(product(modelling.WEIGHT_GRID, repeat=3)) and len(rows) == 1000
    assert all(a.auc >= b.auc for a, b in zip(rows, rows[1:])) and (2.0, 3.0, 0.1) in {tuple(r.weights) for r in rows}


def test_weight_search_finds_the_member_that_knows(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    rows = [(int(v), float(np.clip(v * 0.5 + rng.random() * 0.5, 0, 1)), float(rng.random())) for v in y]
    df = spark.createDataFrame(rows, "label int, p_good double, p_noise double")
    got = metrics.weight_search(df, ["p_good", "p_noise"], "label", [0.1, 1.0, 5.0]).collect()
    assert tuple(got[0].weights) == (5.0, 0.1) and got[0].auc > 0.99
    for r in got:  # against ranks of the votes themselves
        p = np.array([round((r.weights[0] * a + r.weights[1] * b) / sum(r.weights), 12) for _, a, b in rows])
        pos, neg = p[y == 1], p[y == 0]
        assert r.auc == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2), abs=1e-12)


def test_permutation_importance_tells_signal_from_noise(spark, tmp_path):
    df = spark.range(800).selectExpr("id as k", "cast(id % 2 as int) as label", "cast(id % 2 as double) + rand(1) as signal", "rand(2) as noise")
    models = ml.fit(ml.baseline_members(["signal", "noise"], 800), df)
    got = {r.feature: r.importance for r in ml.permutation_importance(ml.voter(models, dict.fromkeys(models, 1.0)), df, "k", ["signal", "noise"], repeats=2).collect()}
    assert got["signal"] > 0.3 and abs(got["noise"]) < 0.05
    ml.save(models, {"features": ["signal", "noise"], "weights": [1.0, 1.0]}, str(tmp_path / "m"))
    loaded, meta = ml.load(str(tmp_path / "m"))
    assert meta["features"] == ["signal", "noise"] and list(loaded) == ["lr", "dt"]
    both = [sorted(r.p for r in ml.soft_vote(ml.member_probabilities(m, df), dict.fromkeys(m, 1.0)).select("p").collect()) for m in (models, loaded)]
    assert both[0] == both[1]


def test_members_have_the_reference_settings():
    members = ml.baseline_members(["x"], 200)
    assert members["dt"].getStages()[-1].getMaxDepth() == 8 and members["dt"].getStages()[-1].getMinInstancesPerNode() == 50
    assert members["lr"].getStages()[-1].getRegParam() == 1 / 200


def test_tuned_baseline_tries_both_grids(spark):
    rows = modelling.QUERIES["o115_tuned_baseline"](spark, SF).collect()
    assert sum(r.member == "lr" for r in rows) == 8 and sum(r.member == "dt" for r in rows) == 12
    assert all(0 <= r.auc <= 1 for r in rows)
    best = ml.best_settings(spark.createDataFrame(rows))
    members = ml.tuned_members(["x"], best)
    assert members["dt"].getStages()[-1].getMaxDepth() == best["dt"]["max_depth"] in ml.DT_DEPTH and members["lr"].getStages()[-1].getElasticNetParam() == best["lr"]["l1_ratio"]


def test_members_are_fitted_side_by_side(spark):
    """Each of two members waits for the other to begin, which one after the other never ends."""
    from threading import Barrier

    both = Barrier(2, timeout=20)

    class Member:
        def __init__(self, name):
            self.name = name

        def fit(self, df):
            both.wait()
            return self.name, df.count()

    assert ml.fit({"a": Member("x"), "b": Member("y")}, spark.range(3)) == {"a": ("x", 3), "b": ("y", 3)} and ml.fit({}, spark.range(3)) == {}

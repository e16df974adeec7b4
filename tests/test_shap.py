"""Shapley values of trees against sums over all subsets of features, and against the models' own margins."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from matchloom.operators import ml, shap

NAMES = ["a", "b", "c", "d"]


def expectation(by, node, row, known):
    """The tree's value where only ``known`` features of the row are given: the rest follow the training rows."""
    if node.left < 0:
        return node.value
    left, right = by[node.left], by[node.right]
    if node.feature in known:
        x = row[node.feature]
        goes = x in node.categories if node.categories is not None else x <= node.threshold
        return expectation(by, left if goes else right, row, known)
    z = left.rows / (left.rows + right.rows)
    return z * expectation(by, left, row, known) + (1 - z) * expectation(by, right, row, known)


def brute(nodes, row, n, mean):
    total = nodes.groupby("tree")["weight"].first().sum() if mean else 1.0
    out = np.zeros(n)
    for _, tree in nodes.groupby("tree"):
        by = {r.id: r for r in tree.itertuples()}
        for j in range(n):
            for k in range(n):
                for s in combinations([i for i in range(n) if i != j], k):
                    gain = expectation(by, by[0], row, {*s, j}) - expectation(by, by[0], row, set(s))
                    out[j] += by[0].weight / total * gain * factorial(k) * factorial(n - k - 1) / factorial(n)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) * 0.3) > 0).astype(int)
    data = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame([*data, (400, None, 0.1, float("nan"), 0.2, 1)], "id long, a double, b double, c double, d double, label int")


@pytest.mark.parametrize("classifier", [(DecisionTreeClassifier, {"maxDepth": 4}), (RandomForestClassifier, {"numTrees": 5, "maxDepth": 4}), (GBTClassifier, {"maxIter": 4, "maxDepth": 3})])
def test_values_equal_brute_force_and_sum_to_the_margin(spark, rows, classifier):
    kind, settings = classifier
    model = ml._pipeline(NAMES, kind(seed=1, **settings)).fit(rows.where("id < 400"))
    leaves, expected = shap.explainer(model)
    boosted = kind is GBTClassifier
    margin = vector_to_array("rawPrediction" if boosted else "probability")[1].alias("margin")
    got = shap.explained(model.transform(rows).select("id", *NAMES, margin), NAMES, leaves, expected).orderBy("id").collect()
    assert len(got) == 401 and all(abs(r.margin - r.shap_expected - sum(r.shap)) < 1e-9 for r in got)
    nodes = shap.node_table(model.stages[-1]).toPandas()
    for r in got[:12] + got[-1:]:
        row = [float("nan") if r[n] is None else r[n] for n in NAMES]
        assert np.allclose(r.shap, brute(nodes, row, 4, mean=not boosted), atol=1e-10)


def test_categories_and_repeated_features():
    nodes = pd.DataFrame(
        [(0, 1.0, 0, 1, 2, 0, 10, 0.0, None, [0.0, 2.0], 3), (0, 1.0, 1, -1, -1, -1, 6, 1.0, None, None, -1), (0, 1.0, 2, 3, 4, 1, 4, 0.0, 0.5, None, -1), (0, 1.0, 3, 5, 6, 1, 3, 0.0, -0.5, None, -1)]
        + [(0, 1.0, 4, -1, -1, -1, 1, 5.0, None, None, -1), (0, 1.0, 5, -1, -1, -1, 1, -2.0, None, None, -1), (0, 1.0, 6, -1, -1, -1, 2, 3.0, None, None, -1)],
        columns=["tree", "weight", "id", "left", "right", "feature", "rows", "value", "threshold", "categories", "arity"],
    ).astype({"categories": object})
    nodes["categories"] = [c if isinstance(c, list) else None for c in nodes["categories"]]
    leaves, expected = shap.leaves_of(nodes)
    x = np.array([[0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [1.0, -2.0], [2.0, np.nan], [1.0, np.nan]])
    got = shap.values(leaves, x)
    for row, v in zip(x, got):
        assert np.allclose(v, brute(nodes, list(row), 2, mean=False))
    assert expected == pytest.approx(0.6 * 1 + 0.4 * (0.75 * (1 / 3 * -2 + 2 / 3 * 3) + 0.25 * 5))


def test_mean_of_absolute_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0, 0.0]), (2, [-3.0, 0.0, 0.0])], "id int, shap array<double>")
    assert [tuple(r) for r in shap.mean_absolute(df, ["x", "y", "z"], top=2).collect()] == [("x", 2.0), ("y", 1.0)]
    assert shap.mean_absolute(df.where("id > 9"), ["x", "y", "z"]).count() == 0
    none = spark.createDataFrame([], "a double")
    assert shap.explained(none.select(F.col("a")), ["a"], [], 0.5).collect() == []


def test_rows_of_one_cell_are_explained_once(spark, rows):
    """As many cells however often the rows are repeated, and the same means as over all rows, null and NaN included."""
    model = ml._pipeline(NAMES, GBTClassifier(seed=1, maxIter=3, maxDepth=2)).fit(rows.where("id < 400"))
    leaves, expected = shap.explainer(model)
    many = rows.union(rows).union(rows.where("id > 300"))
    found = shap.cells(many, NAMES, leaves)
    assert found.count() == shap.cells(rows, NAMES, leaves).count() < 200 and found.agg(F.sum("n")).first()[0] == many.count()
    got = shap.mean_absolute(shap.explained(found, NAMES, leaves, expected), NAMES, times="n").collect()
    want = shap.mean_absolute(shap.explained(many, NAMES, leaves, expected), NAMES).collect()
    assert [r.feature for r in got] == [r.feature for r in want]
    assert [r.mean_abs_shap for r in got] == pytest.approx([r.mean_abs_shap for r in want], abs=1e-12)
    assert shap.cells(rows.where("id < 0"), NAMES, leaves).count() == 0

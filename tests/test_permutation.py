"""Permutations met in blocks of places, and areas of many cases from one shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import metrics, ml, splits


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_blocks_deal_as_shuffled_labels_do(spark, block):
    df = spark.createDataFrame([(i if i else None, i * 10) for i in range(300)], "k long, v long")
    got = splits.permuted(df, "k", ["v"], 3, block=block)
    assert exchanges(got) == 1  # rows meet once, in blocks
    for repeat in range(3):
        want = {r.k: r.v for r in splits.shuffled_labels(df, "k", "v", seed=42 + repeat).collect()}
        assert {r.k: r.donor.v for r in got.where(F.col("repeat") == repeat).collect()} == want


@pytest.mark.parametrize("block", [20, 1000])
def test_rows_of_one_key_are_dealt_too(spark, block):
    """With ``block`` 20 more rows share a hash than a block holds."""
    df = spark.createDataFrame([(i % 3 or None, i, None if i % 5 else "x") for i in range(120)], "k long, v long, w string")
    rows = splits.permuted(df, "k", ["v", "w"], 2, block=block).collect()
    for repeat in range(2):
        mine = [r for r in rows if r.repeat == repeat]
        assert sorted(r.v for r in mine) == sorted(r.donor.v for r in mine) == list(range(120))
        assert all(r.donor.w == (None if r.donor.v % 5 else "x") for r in mine)
    assert sorted(map(str, rows)) == sorted(map(str, splits.permuted(df, "k", ["v", "w"], 2, block=240).collect()))
    assert splits.permuted(df.where("v < 0"), "k", ["v"], 2).count() == 0


@pytest.mark.parametrize("spread", [3, 40, 10**6])
def test_areas_are_those_of_the_sorted_scores(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(int(c), float("nan") if s == 1 else float(s / 7), None if s % 10 == 9 else int(y)) for c, s, y in zip(rng.integers(-1, 3, 3000), rng.integers(0, spread, 3000), rng.integers(0, 2, 3000))]
    df = spark.createDataFrame([*rows, (7, 0.5, 1), (8, None, 1), (6, 0.0, 0), (6, -0.0, 1)], "c int, s double, y int")
    want = {r.c: r.auc for r in metrics.auc(df, "s", "y", ["c"]).collect()}
    for like in (df, df.where("s < 0.3"), df.where("c > 99")):
        got = metrics.areas(df, "c", "s", "y", like, parts=8)
        assert {r.c: r.auc for r in got.collect()} == pytest.approx(want, abs=1e-14, nan_ok=True)


def test_importance_shuffles_rows_twice(spark):
    """To the blocks and to the parts of the scores; before, six shuffles, four of them after the expansion."""
    df = spark.range(500).selectExpr("id as k", "cast(id % 2 as int) as label", "cast(id % 7 as double) as a", "cast(id % 2 as double) as b")
    got = ml.permutation_importance(lambda rows: rows.withColumn("p", F.col("a") + 10 * F.col("b")), df, "k", ["a", "b"], repeats=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") <= 2 and "Join" in plan and plan.count("FlatMapGroupsInArrow") == 2
    assert {r.feature: r.importance > 0.3 for r in got.collect()} == {"a": False, "b": True}

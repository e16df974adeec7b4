"""Exact cuts, folds of like size over skewed groups, and permutations of all rows."""

import pytest
from pyspark.sql import functions as F

from matchloom.operators import splits


def test_exact_split_cuts_at_the_row(spark):
    df = spark.createDataFrame([(i if i % 7 else None,) for i in range(57)], "k long")
    got = {r.split: r["count"] for r in splits.exact_split(df, "k").groupBy("split").count().collect()}
    assert got == {"train": int(0.8 * 57), "test": 57 - int(0.8 * 57)}
    assert splits.exact_split(df.where("k < 0"), "k").count() == 0


def test_balanced_folds_of_skewed_groups(spark):
    """A group with a seventh of the rows, a hundred of some size, and thousands of single rows: folds within 1 % of the mean."""
    sizes = [3000] + [40 + i for i in range(100)] + [2] * 1500 + [1] * 6000
    rows = [(g if g else None,) for g, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "g long")
    got = splits.balanced_folds(df, "g", 5)
    each = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(each) == 5 and sum(each) == len(rows) and max(each) <= 1.01 * len(rows) / 5
    assert got.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    again = splits.balanced_folds(df.repartition(3), "g", 5)
    assert sorted(map(tuple, got.distinct().collect()), key=repr) == sorted(map(tuple, again.distinct().collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1])
def test_balanced_folds_of_few_rows(spark, n):
    df = spark.createDataFrame([(i, "x") for i in range(n)], "g long, fold_ string")
    assert splits.balanced_folds(df, "g").count() == n


def test_permutations_deal_as_shuffled_labels_do(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(200)], "k long, v long")
    got = splits.permuted(df, "k", ["v"], repeats=3)
    for repeat in range(3):
        want = {r.k: r.v for r in splits.shuffled_labels(df, "k", "v", seed=42 + repeat).collect()}
        assert {r.k: r.donor.v for r in got.where(F.col("repeat") == repeat).collect()} == want
        assert sorted(want.values()) == [i * 10 for i in range(200)]

"""Shapley values of tree ensembles, path-dependent: what each feature adds to a row's margin.

A model's saved node table (one row a node: threshold, children, leaf value, rows that reached it in training) is turned into
one record a leaf: the interval that the path asks of each of its features and the share of the training rows that pass it.
That table is bounded by the model, never by the data, and is broadcast; rows go through it in Arrow batches.

For a leaf with value v and features F on its path, a feature j that the row satisfies (o = 1) or not (o = 0) and whose
conditions a share z of the rows pass adds v (o - z) times the sum, over subsets S of the others, of |S|! (|F| - |S| - 1)! / |F|!
times the product of o over S and of z over the rest: the coefficients of the product of (z + o t). These depend on the row
only by which conditions it meets, so that each pattern found in a batch is worked out once for each leaf.

Defined results: a null or NaN feature goes right, as in the models themselves; the values of a row and the expected value sum
to the model's margin (a forest's or tree's probability of class 1; the raw score of boosted trees); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.shared import shared_dir


@dataclass
class Leaf:
    """A leaf's weighted value, its path's features, the interval (low, high] that each needs (None: categories), and the
    share of training rows that pass each feature's conditions."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sets: dict[int, frozenset]
    share: np.ndarray


def node_table(model) -> DataFrame:
    """tree, weight, id, left, right, feature, threshold, categories, rows and value of every node of a Spark ML tree model.

    The model's own saved form is read; a class's share is the value of classification trees, the prediction of others.
    """
    spark = SparkSession.active()
    path = shared_dir(spark)
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        trees = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "meta", "weight").select("tree", "weight")
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(F.broadcast(trees), "tree")  # a row a tree
    else:
        data = data.select(F.lit(0).alias("tree"), F.lit(1.0).alias("weight"), "*")
    stats, regression = F.col("impurityStats"), not hasattr(model, "numClasses") or hasattr(model, "getMaxIter")
    value = F.col("prediction") if regression else F.get(stats, 1) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    split = F.col("split")
    return data.select(
        "tree", "weight", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), split["featureIndex"].alias("feature"), F.col("rawCount").alias("rows"), value.alias("value"),
        F.when(split["numCategories"] == -1, F.get(split["leftCategoriesOrThreshold"], 0)).alias("threshold"), F.when(split["numCategories"] != -1, split["leftCategoriesOrThreshold"]).alias("categories"), split["numCategories"].alias("arity"),
    )


def leaves_of(nodes: pd.DataFrame, mean: bool = False) -> tuple[list[Leaf], float]:
    """The leaves of all trees of a node table and the expected value. ``mean``: trees are averaged by weight, else summed."""
    total = nodes.groupby("tree")["weight"].first().sum() if mean else 1.0
    out, expected = [], 0.0
    for _, tree in nodes.groupby("tree"):
        by = {r.id: r for r in tree.itertuples()}
        root = by[0]

        def walk(node, path: list) -> None:
            if node.left < 0:
                low, high, sets, share = {}, {}, {}, {}
                for f, kind, bound, z in path:
                    share[f] = share.get(f, 1.0) * z
                    if kind == "set":
                        sets[f] = sets[f] & bound if f in sets else bound
                    else:
                        low.setdefault(f, -np.inf), high.setdefault(f, np.inf)
                        low[f], high[f] = (max(low[f], bound), high[f]) if kind == "above" else (low[f], min(high[f], bound))
                keys = sorted(share)
                out.append(Leaf(node.value * node.weight / total, np.array(keys, dtype=int), np.array([low.get(k, -np.inf) for k in keys]), np.array([high.get(k, np.inf) for k in keys]), sets, np.array([share[k] for k in keys])))
                return
            left, right = by[node.left], by[node.right]
            z = left.rows / (left.rows + right.rows)
            if node.categories is not None:
                yes = frozenset(int(c) for c in node.categories)
                walk(left, [*path, (node.feature, "set", yes, z)])
                walk(right, [*path, (node.feature, "set", frozenset(range(int(node.arity))) - yes, 1 - z)])
            else:
                walk(left, [*path, (node.feature, "to", node.threshold, z)])
                walk(right, [*path, (node.feature, "above", node.threshold, 1 - z)])

        start = len(out)
        walk(root, [])
        expected += sum(x.value * x.share.prod() for x in out[start:])
    return out, float(expected)


def _added(leaf: Leaf, met: np.ndarray) -> np.ndarray:
    """What each feature of the leaf adds, for each row of 0/1 conditions ``met``."""
    m = len(leaf.features)
    out = np.zeros((len(met), m))
    for j in range(m):
        poly = np.ones((len(met), 1))
        for i in range(m):
            if i != j:
                wide = np.zeros((len(met), poly.shape[1] + 1))
                wide[:, :-1] += poly * leaf.share[i]
                wide[:, 1:] += poly * met[:, i : i + 1]
                poly = wide
        weights = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
        out[:, j] = leaf.value * (met[:, j] - leaf.share[j]) * (poly @ weights)
    return out


def values(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """The Shapley values of each row of ``x`` and each of its columns."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if not len(leaf.features):
            continue
        own = x[:, leaf.features]
        met = ~(own <= leaf.low) & ((own <= leaf.high) | np.isinf(leaf.high))  # NaN is above every threshold
        for f, allowed in leaf.sets.items():
            met[:, np.flatnonzero(leaf.features == f)[0]] = np.isin(own[:, np.flatnonzero(leaf.features == f)[0]], list(allowed))
        codes = met @ (1 << np.arange(len(leaf.features), dtype=np.int64))
        _, first, at = np.unique(codes, return_index=True, return_inverse=True)
        out[:, leaf.features] += _added(leaf, met[first].astype(float))[at]
    return out


def explainer(model) -> tuple[list[Leaf], float]:
    """The leaf table and expected value of a Spark ML tree, forest or boosted-tree model, or a pipeline that ends in one."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    nodes = node_table(last).toPandas()  # bounded by the model
    return leaves_of(nodes, mean=not hasattr(last, "getMaxIter"))


def explained(df: DataFrame, features: Sequence[str], leaves: Sequence[Leaf], expected: float, name: str = "shap") -> DataFrame:
    """``df`` with ``name``, an array of the features' Shapley values in order, and ``name``_expected."""
    table = df.sparkSession.sparkContext.broadcast(list(leaves))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            yield pd.Series(list(values(table.value, x)))

    return df.withColumns({name: run(*(F.col(f).cast("double") for f in features)), f"{name}_expected": F.lit(expected)})


def cells(df: DataFrame, features: Sequence[str], leaves: Sequence[Leaf]) -> DataFrame:
    """``features`` and n: the rows that lie between the same thresholds of the leaves in every feature, and so have the same
    values, as one row. Their number is bounded by the model's thresholds (and categories), whatever the rows are.
    """
    cuts: dict[int, set] = {}
    whole = set()
    for leaf in leaves:
        whole.update(leaf.sets)
        for f, *ends in zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist()):
            cuts.setdefault(f, set()).update(t for t in ends if np.isfinite(t))
    x = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]  # null goes right as NaN does
    below = lambda i: F.size(F.filter(F.array(*map(F.lit, sorted(cuts[i]))), lambda t: t < x[i])) if cuts.get(i) else F.lit(0)
    keys = [(x[i] if i in whole else below(i)).alias(f"_k{i}") for i in range(len(features))]
    return df.select(*(c.alias(f) for c, f in zip(x, features)), *keys).groupBy(*(f"_k{i}" for i in range(len(features)))).agg(*(F.min(f).alias(f) for f in features), F.count("*").alias("n")).select(*features, "n")


def mean_absolute(df: DataFrame, features: Sequence[str], name: str = "shap", top: int = 20, times: str | None = None) -> DataFrame:
    """feature, mean_abs_shap and place (from 1) of the ``top`` features by the mean of |value| over all rows; a row counts ``times``
    times."""
    n = F.col(times) if times else F.lit(1)
    each = df.select(n.alias("n"), F.posexplode(name).alias("i", "x")).groupBy("i").agg((F.sum(F.abs("x") * F.col("n")) / F.sum("n")).alias("mean_abs_shap"))  # a row a feature
    named = each.select(F.element_at(F.array(*map(F.lit, features)), F.col("i") + 1).alias("feature"), "mean_abs_shap")
    return named.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)

"""Classification metrics as aggregates; no scores are collected."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, probability: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp, accuracy, F1 and the majority class's share."""
    p, y = (F.col(probability) >= 0.5).cast("int"), F.col(label)
    t = df.where(F.col(probability).isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 1) & (y == 1)).alias("tp")
    )
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return t.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / n, "f1": f1, "majority": F.greatest(F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")) / n})


def score_table(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at each distinct score: what ranking metrics need, combined map-side."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def running(t: DataFrame, by: Sequence[str], order: str, values: Sequence[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """``t`` with before_<v>, the sum of each value over the rows that come earlier in ``order``, which is unique in a group.

    Each group is cut at ``parts`` - 1 approximate quantiles; a part sums its own rows in order and starts from the sums of
    the parts before it. The sums are exact whatever the quantiles are; only one row a part meets in one place.
    """
    cuts = t.groupBy(*by).agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    if by:
        placed = t.join(cuts.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_cuts"), [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(*(f"_by_{c}" for c in by))
    else:
        placed = t.crossJoin(F.broadcast(cuts))  # one row
    part = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    placed = placed.withColumn("_part", -part if descending else part).drop("_cuts")
    sums = placed.groupBy(*by, "_part").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_p"), *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_start_{v}") for v in values))
    rows = Window.partitionBy(*by, "_part").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *(F.coalesce(F.sum(v).over(rows), F.lit(0)).alias(f"_in_{v}") for v in values))
    joined = inside.join(starts, [F.col("_part") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)])
    return joined.select(*t.columns, *((F.col(f"_start_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}") for v in values))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """The area under the ROC curve with ties counted half; null where a class is missing."""
    below = running(score_table(df, score, label, by), by, "s", ["neg"])
    g = below.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return g.select(*by, F.try_divide(F.col("u"), F.col("np") * F.col("nn")).alias("auc"))


def _parts(df: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """``df`` with ``part``, which grows with the number ``s``: of each cut, 2 b for the scores that equal it, 2 b + 1 up to the next."""
    if not cuts:
        return df.withColumn("part", F.lit(1))
    # its own search by halves: so many comparisons in one expression are more than the JVM compiles
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="s", outputCol="_b", handleInvalid="keep").transform(df)
    b = F.col("_b").cast("int")
    equal = F.coalesce(F.get(F.array(*map(F.lit, cuts)), b - 1) == F.col("s"), F.lit(False))
    return placed.withColumn("part", 2 * b + F.when(equal, 0).otherwise(1)).drop("_b")


#: A score that is a cut may be that of very many rows: they are dealt to so many tasks.
SALTS = 16


def areas(df: DataFrame, case: str, score: str, label: str, like: DataFrame, parts: int = 64) -> DataFrame:
    """``auc`` by the whole number ``case``, for many cases of many different scores: one shuffle of the rows as they are.

    ``like`` has scores that are spread like those of ``df``; its approximate quantiles cut all cases into ``parts``. A part of a
    case is sorted by itself and tells how often its ones beat its own zeros; the zeros of the parts before it are added.
    The areas are exact whatever the cuts are. Labels are 0 or 1.
    """
    found = like.agg(F.percentile_approx(F.col(score).cast("double"), [i / parts for i in range(1, parts)], 1_000)).first()[0] or []
    cuts = sorted({c for c in found if math.isfinite(c)})
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(case).cast("long").alias("_c"), F.when(F.col(score) == 0, 0.0).otherwise(F.col(score).cast("double")).alias("s"), (F.col(label) == 1).alias("y"))
    width = 2 * len(cuts) + 4
    salt = F.when(F.col("part") % 2 == 0, F.spark_partition_id() % SALTS).otherwise(0)
    keyed = _parts(known, cuts).select(((F.col("_c") * width + F.col("part")) * SALTS + salt).alias("_k"), "s", "y")

    def count(table: pa.Table) -> pa.Table:
        k, s, y = table.column("_k")[0].as_py(), table.column("s").to_numpy(), table.column("y").to_numpy()
        ones, zeros = np.sort(s[y]), np.sort(s[~y])  # ones are sorted for speed alone
        won = int(zeros.searchsorted(ones, "left").sum() + zeros.searchsorted(ones, "right").sum())  # twice, as ties count half
        return pa.table({"_k": [k], "pos": [len(ones)], "neg": [len(zeros)], "won": [won]})

    each = keyed.groupBy("_k").applyInArrow(count, "_k long, pos long, neg long, won long")
    at = F.floor(F.col("_k") / F.lit(SALTS))
    sums = each.groupBy(at.alias("_p")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    of, equal = F.floor(F.col("_p") / F.lit(width)), F.col("_p") % 2 == 0
    placed = sums.select(of.alias("_c"), "_p", "pos", "neg", F.when(equal, F.col("pos") * F.col("neg")).otherwise(F.col("won")).alias("won"))
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = placed.select("_c", "pos", "neg", (F.col("won") + 2 * F.col("pos") * before).alias("won"))  # a row a part
    g = won.groupBy("_c").agg(F.sum("won").alias("won"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return g.select(F.col("_c").cast(df.schema[case].dataType).alias(case), F.try_divide(F.col("won") / 2, F.col("np") * F.col("nn")).alias("auc"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, fpr, tpr, Youden's J and ``place`` from 0 at each distinct score, highest first."""
    t = score_table(df, score, label)
    total = F.broadcast(t.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn")))  # one row
    r = running(t.withColumn("one", F.lit(1)), (), "s", ["pos", "neg", "one"], descending=True).crossJoin(total)
    share = lambda c, n: F.try_divide(F.col(f"before_{c}") + F.col(c), F.col(n))
    r = r.select(F.col("s").alias("threshold"), share("neg", "nn").alias("fpr"), share("pos", "np").alias("tpr"), F.col("before_one").cast("long").alias("place"))
    return r.withColumn("j", F.col("tpr") - F.col("fpr"))


def thinned(curve: DataFrame, points: int = 260, place: str = "place") -> DataFrame:
    """The rows at ``points`` evenly spaced places, rounded down, the first and last included; all rows of a shorter curve."""
    n = curve.count()
    if n <= points:
        return curve
    return curve.where(F.col(place).isin(*{int(k * (n - 1) / (points - 1)) for k in range(points)}))


def single_feature_auc(df: DataFrame, features: Sequence[str], label: str, problem: float = 0.95, warn: float = 0.85) -> DataFrame:
    """max(AUC, 1 - AUC) of each feature alone, constants left out, with a flag; one unpivot, one shuffle."""
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features)))
    long = df.select(F.col(label).alias("y"), items.alias("i")).select("y", "i.feature", "i.x")
    varied = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("feature")
    a = auc(long.join(varied, "feature", "left_semi"), "x", "y", ["feature"]).select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))
    return a.withColumn("flag", F.when(F.col("auc") > problem, "problem").when(F.col("auc") > warn, "warn").otherwise("ok"))


def fold_metrics(df: DataFrame, fold: str, probability: str, label: str) -> DataFrame:
    """AUC, accuracy and F1 of each fold, and their mean and population deviation in the row with a null fold."""
    each = auc(df, probability, label, [fold]).join(confusion(df, probability, label, [fold]), fold).select(fold, "auc", "accuracy", "f1")
    names = ("auc", "accuracy", "f1")
    mean = each.agg(*(F.avg(c).alias(c) for c in names), *(F.stddev_pop(c).alias(f"{c}_std") for c in names))
    return each.select(fold, *names, *(F.lit(None).cast("double").alias(f"{c}_std") for c in names)).unionByName(mean.withColumn(fold, F.lit(None).cast(df.schema[fold].dataType)))


def deltas(metrics: DataFrame, model: str, ensemble: str, baseline: str, value: str = "auc") -> DataFrame:
    """The best single model, and the ensemble's gain over it and over the baseline."""
    single = ~F.col(model).isin(ensemble, baseline)
    one = metrics.agg(F.max_by(F.when(single, F.col(model)), F.when(single, F.col(value))).alias("best_single"), F.max(F.when(single, F.col(value))).alias("best"), F.max(F.when(F.col(model) == ensemble, F.col(value))).alias("e"), F.max(F.when(F.col(model) == baseline, F.col(value))).alias("b"))
    return one.select("best_single", (F.col("e") - F.col("best")).alias("gain_over_single"), (F.col("e") - F.col("b")).alias("gain_over_baseline"))


def weight_search(df: DataFrame, members: Sequence[str], label: str, grid: Sequence[float], digits: int | None = None) -> DataFrame:
    """AUC of every weighted soft vote over a grid, best first; earlier weights win ties.

    Rows of equal scores and label are counted before the weights, a small broadcast table, expand them; equal votes of a
    weighting, those that agree to 12 decimals, are combined map-side. With ``digits``, scores and votes are rounded to so
    many decimals: that bounds what a weighting shuffles by the different votes, but ties and the best weights may differ
    from the exact search's.
    """
    from itertools import product

    combos = [tuple(map(float, w)) for w in product(grid, repeat=len(members)) if sum(w) > 0]
    table = F.broadcast(df.sparkSession.createDataFrame([(i, list(w), float(sum(w))) for i, w in enumerate(combos)], "i int, weights array<double>, total double"))
    known = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), *((F.round(m, digits) if digits else F.col(m)).alias(m) for m in members))
    counted = known.groupBy("y", *members).agg(F.count("*").alias("n"))
    vote = sum((F.col(m) * F.col("weights")[k] for k, m in enumerate(members)), F.lit(0.0)) / F.col("total")
    votes = counted.crossJoin(table).where(vote.isNotNull()).select("i", F.round(vote, digits or 12).alias("s"), "y", "n")
    t = votes.groupBy("i", "s").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    below = running(t, ["i"], "s", ["neg"], parts=2)
    g = below.groupBy("i").agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    scored = g.select("i", F.try_divide(F.col("u"), F.col("np") * F.col("nn")).alias("auc"))
    return scored.join(table, "i").select("i", "weights", "auc").orderBy(F.desc("auc"), "i")


def overfit_report(train: DataFrame, test: DataFrame, probability: str, label: str, most_gap: float = 0.05) -> DataFrame:
    """One row: AUC, accuracy and F1 of both splits, the gaps of AUC and accuracy between them, whether the latter warns of
    overfitting, and the test accuracy's gain over always naming the majority class."""
    both = train.select(F.lit("train").alias("split"), probability, label).unionByName(test.select(F.lit("test").alias("split"), probability, label))
    each = confusion(both, probability, label, ["split"]).join(auc(both, probability, label, ["split"]), "split")
    of = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    one = each.agg(*(of(s, c) for s in ("train", "test") for c in ("auc", "accuracy", "f1")), of("test", "majority"))
    gap = F.col("train_accuracy") - F.col("test_accuracy")
    return one.withColumns({"auc_gap": F.col("train_auc") - F.col("test_auc"), "accuracy_gap": gap, "overfit": gap > most_gap, "over_majority": F.col("test_accuracy") - F.col("test_majority")})

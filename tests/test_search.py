"""The Parzen search: better than even draws, the same after a kill, and no trial twice."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from matchloom.operators import metrics, ml, search
from matchloom.operators.search import Range
from matchloom.plans import modelling
from matchloom.sources.shared import Store, shared_dir

SPACE = {"x": Range(-5, 5), "k": Range(1, 40, whole=True), "rate": Range(1e-4, 1.0, log=True)}


def hill(p):
    return -((p["x"] - 2) ** 2) - ((p["k"] - 9) / 8) ** 2 - (np.log10(p["rate"]) + 2) ** 2


def run(n, startup, seed):
    done = []
    for i in range(n):
        p = search.propose(SPACE, done, i, seed, startup)
        done.append((p, hill(p)))
    return max(v for _, v in done)


def test_better_than_even_draws():
    assert all(run(60, 10, s) > run(60, 60, s) for s in (1, 2, 3)) and run(60, 10, 42) > -0.3


def test_proposals_stay_in_their_range():
    done = [({"x": -5.0, "k": 40.0, "rate": 1.0}, 1.0), ({"x": 5.0, "k": 1.0, "rate": 1e-4}, 0.0)]
    for i in range(200):
        p = search.propose(SPACE, done, i, 7, 10)
        assert -5 <= p["x"] <= 5 and p["k"] == int(p["k"]) and 1 <= p["k"] <= 40 and 1e-4 <= p["rate"] <= 1


def test_density_is_one_over_the_range():
    mix = search.Parzen([0.1, 0.1, 0.9], 0.0, 1.0)
    x = np.linspace(0, 1, 20_001)
    assert np.trapezoid(np.exp(mix.log_density(x)), x) == pytest.approx(1, abs=1e-3)


def test_a_killed_run_goes_on_without_repeating(spark):
    calls, root = [], shared_dir(spark)

    def fails(p):
        calls.append(tuple(p.values()))
        if len(calls) > 6:
            raise RuntimeError("killed")
        return hill(p)

    with pytest.raises(RuntimeError, match="killed"):
        search.Study(spark, root, SPACE, startup=4, wave=3).run(fails, 9)
    kept = {r.number: r.params for r in search.Study(spark, root, SPACE).trials().collect()}
    assert len(kept) >= 6
    calls.clear()
    again = {r.number: r.params for r in search.Study(spark, root, SPACE, startup=4, wave=3).run(lambda p: calls.append(tuple(p.values())) or hill(p), 9).collect()}
    assert len(calls) == 9 - len(kept) and len(again) == 9 and kept.items() <= again.items()
    whole = search.Study(spark, shared_dir(spark), SPACE, startup=4, wave=3).run(hill, 9)
    assert {r.number: r.params for r in whole.collect()} == again
    best = [r for r in search.report(whole).collect() if r.best]
    assert len(best) == 1 and best[0].value == max(r.value for r in whole.collect())


def test_a_batch_published_during_compaction_stays(spark):
    store = Store(spark, shared_dir(spark))
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    assert store.commit("a", one(1)) and store.commit("b", one(2)) and not store.commit("a", one(9))
    seen = store.batches()
    total = store.read("n int", seen)
    store.commit("c", one(4))
    store.commit("ab", total, replaces=seen)
    assert sorted(r.n for r in store.read("n int").collect()) == [1, 2, 4] and set(store.batches()) == {"ab", "c"}


def test_batches_laid_out_by_columns(spark):
    store = Store(spark, shared_dir(spark), ["p"])
    assert store.read("n int, p int").count() == 0
    store.commit("a", spark.createDataFrame([(1, 0), (2, 1)], "n int, p int"))
    store.commit("b", spark.createDataFrame([(3, 1)], "n int, p int"))
    got = store.read("n int, p int").where("p = 1")
    assert sorted(r.n for r in got.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(p#" in got._jdf.queryExecution().executedPlan().toString()


def test_a_trial_scores_its_rows_once(spark):
    """An area reads its scores several times: without a written table each reading scores them anew."""
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def p(x):
        scored.add(1)
        return x / 7 % 1

    class Model:
        def transform(self, df):
            return df.withColumn("probability", array_to_vector(F.array(F.lit(0.0), p.asNondeterministic()("x"))))

    rows = spark.range(300).selectExpr("cast(id as double) as x", "cast(id % 3 = 0 as int) as label")
    area = metrics.auc(ml.member_probabilities({"m": Model()}, rows), "p_m", "label").first().auc
    assert scored.value > 300
    scored.value = 0
    assert modelling._area({"m": Model()}, rows) == area and scored.value == 300

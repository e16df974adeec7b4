"""Parameter search by a tree of Parzen estimators, with parallel trials in a table that outlives the run.

Trials come in waves. A wave's proposals depend on the seed, their own numbers and the trials of earlier waves alone, so that a
run that was killed, or that runs its trials in another order, proposes the same: what is published is not tried again, the
rest is proposed anew. Each finished trial is one batch of a ``Store`` and so is published whole or not at all.

The first ``startup`` trials are drawn evenly. From then on, for each parameter by itself, the best tenth of the earlier trials
and the others each become a mixture of truncated normals (one a trial, as wide as the gap to its neighbours, and one over the
whole range); of ``candidates`` drawn from the first, the one with the largest ratio of both densities is proposed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.shared import Store

TRIAL = "number int, params map<string,double>, value double"


@dataclass(frozen=True)
class Range:
    """A parameter from ``low`` to ``high``; ``whole``: integers; ``log``: even on a logarithmic scale."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def bounds(self) -> tuple[float, float]:
        low, high = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        return (math.log(low), math.log(high)) if self.log else (low, high)

    def inner(self, v: float) -> float:
        return math.log(v) if self.log else v

    def outer(self, u: float) -> float:
        v = math.exp(u) if self.log else u
        return float(min(self.high, max(self.low, round(v) if self.whole else v)))


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


class Parzen:
    """A mixture of normals around ``points``, and one around the middle, all cut off at the bounds."""

    def __init__(self, points: Sequence[float], low: float, high: float):
        self.low, self.high, span = low, high, high - low
        self.mu = np.sort(np.append(points, (low + high) / 2))
        edges = np.concatenate([[low], self.mu, [high]])
        gaps = np.maximum(self.mu - edges[:-2], edges[2:] - self.mu)
        self.sigma = np.clip(gaps, span / min(100, len(self.mu) + 1), span)
        self.sigma[np.searchsorted(self.mu, (low + high) / 2)] = span
        self.mass = _cdf((high - self.mu) / self.sigma) - _cdf((low - self.mu) / self.sigma)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(n)
        for i, k in enumerate(rng.integers(0, len(self.mu), n)):
            x = rng.normal(self.mu[k], self.sigma[k])
            while not self.low <= x <= self.high:
                x = rng.normal(self.mu[k], self.sigma[k])
            out[i] = x
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.mu) / self.sigma
        return np.log((np.exp(-0.5 * z * z) / (self.sigma * self.mass * math.sqrt(2 * math.pi))).mean(axis=1) + 1e-300)


def propose(space: dict[str, Range], earlier: Sequence[tuple[dict, float]], number: int, seed: int = 42, startup: int = 10, candidates: int = 24) -> dict[str, float]:
    """The parameters of trial ``number`` after the ``earlier`` trials (parameters, value), where larger values are better."""
    rng = np.random.default_rng([seed, number])
    if number < startup or not earlier:
        return {name: r.outer(rng.uniform(*r.bounds())) for name, r in space.items()}
    ranked = sorted(earlier, key=lambda t: -t[1])
    n_good = max(1, min(25, math.ceil(0.1 * len(ranked))))
    out = {}
    for name, r in space.items():
        values = [r.inner(p[name]) for p, _ in ranked]
        good, rest = Parzen(values[:n_good], *r.bounds()), Parzen(values[n_good:], *r.bounds())
        x = good.draw(rng, candidates)
        out[name] = r.outer(x[np.argmax(good.log_density(x) - rest.log_density(x))])
    return out


class Study:
    """A search whose trials are kept under ``root``; the same root goes on with them."""

    def __init__(self, spark: SparkSession, root: str, space: dict[str, Range], seed: int = 42, startup: int = 10, wave: int = 4):
        self.store, self.space, self.seed, self.startup, self.wave = Store(spark, root), space, seed, startup, wave

    def trials(self) -> DataFrame:
        """number, params and value of all published trials."""
        return self.store.read(TRIAL)

    def run(self, objective: Callable[[dict[str, float]], float], n_trials: int) -> DataFrame:
        """Try until ``n_trials`` are published, a wave of trials at a time in parallel; a trial that fails ends the run."""
        spark = self.store.spark
        done = {r.number: (r.params, r.value) for r in self.trials().collect()}  # one row a trial
        for start in range(0, n_trials, self.wave):
            asked = [n for n in range(start, min(start + self.wave, n_trials)) if n not in done]
            earlier = [done[n] for n in sorted(done) if n < start]

            def one(number: int) -> tuple[int, dict, float]:
                params = propose(self.space, earlier, number, self.seed, self.startup)
                value = float(objective(params))
                self.store.commit(f"trial-{number}", spark.createDataFrame([(number, params, value)], TRIAL).coalesce(1))
                return number, params, value

            if asked:
                with ThreadPoolExecutor(len(asked)) as pool:
                    for number, params, value in pool.map(inheritable_thread_target(spark)(one), asked):
                        done[number] = (params, value)
        return self.trials()


def report(trials: DataFrame) -> DataFrame:
    """The trials, and whether each is the best: the largest value, of equals the first."""
    best = trials.agg(F.max_by("number", F.struct("value", -F.col("number"))).alias("best"))
    return trials.crossJoin(F.broadcast(best)).select("number", "params", "value", (F.col("number") == F.col("best")).alias("best"))  # one row

"""Regimes go through all rounds, however their series are cut or put together."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import regimes
from marlstone.plans import models


def switching(n, seed):
    r = np.random.default_rng(seed)
    state = np.repeat(r.integers(0, 3, n // 5 + 1), 5)[:n]
    x = r.normal(size=n)
    y = np.array([-2, 3, 9])[state] + np.array([1.5, -1, 0.5])[state] * x + 0.8 * r.normal(size=n)
    y[::13] = np.nan
    return np.column_stack([np.ones(n), x, y, np.arange(n) < 0.7 * n])


def test_series_side_by_side_equal_single_ones(monkeypatch):
    model = regimes.Regimes(2, 2, 1e-6, 1e-4)
    series = [switching(n, n) for n in (66, 3, 120, 30, 1, 90)]
    monkeypatch.setattr(regimes, "SIDE", 250)
    together = model.fit(series, 40)
    monkeypatch.setattr(regimes, "SHORT", 0)
    single = model.fit(series, 40)
    for a, b, data in zip(together, single, series):
        assert a[model.size - 1] == b[model.size - 1] == (len(data) > 20) and a[model.size - 2] == b[model.size - 2]
        if len(data) > 20:
            assert np.allclose(a, b, atol=1e-5), len(data)


def test_rounds_go_on_until_the_likelihood_rests():
    model = regimes.Regimes(3, 2, 1e-6, 1e-4)
    rows = switching(300, 5)
    rows[:, 2] += 3 * np.random.default_rng(6).normal(size=300)
    few, all_rounds = model.fit([rows], 8)[0], model.fit([rows], 3000)[0]
    at = model.size - 5  # log likelihood, the one before, rounds, done, enough
    assert all_rounds[at] > few[at] and all_rounds[at + 2] > 8 and abs(all_rounds[at] - all_rounds[at + 1]) < 1e-4 and all_rounds[at + 3] == 1 and few[at + 3] == 0


def test_chunks_without_training_rows_equal_a_series_in_one(spark):
    rows = [(k, t, float(r[1]), None if np.isnan(r[2]) else float(r[2]), bool(r[3])) for k, n in (("a", 150), ("b", 60)) for t, r in enumerate(switching(n, n))]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double, early boolean")
    run = lambda size: {(r.k, r.t): r for r in regimes.markov_regression(df, ["x"], "y", ["k"], ["t"], states=2, rounds=12, train=F.col("early"), rows=size).collect()}
    cut, whole = run(20), run(None)
    assert cut.keys() == whole.keys() and len(cut) == 210
    for at, r in whole.items():
        assert np.allclose(cut[at].p_smoothed, r.p_smoothed, atol=1e-5) and cut[at].path == r.path and cut[at].loglik == pytest.approx(r.loglik, abs=1e-4)


@pytest.mark.parametrize(("query", "operator", "states"), [("regime_regression", "regime_regression", 2), ("regime_forecasts", "walk_forward", 3), ("regime_report", "walk_forward", 3)])
def test_queries_take_the_whole_number_of_rounds_and_states(spark, monkeypatch, query, operator, states):
    plain, seen = getattr(regimes, operator), {}

    def spy(*args, **named):
        bound = inspect.signature(plain).bind(*args, **named)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(models.R, operator, spy)
    with pytest.raises(InterruptedError):
        getattr(models, query)(spark, "/root/testdata/sf0.001")
    assert seen["rounds"] == 80 and seen["states"] == states

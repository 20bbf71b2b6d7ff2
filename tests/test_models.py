"""The sequential models on small series whose truth is known, and the capped strategy against a plain loop."""

import numpy as np
import pytest

from marlstone.operators import models as M
from marlstone.operators import portfolio as P
from marlstone.operators import regimes as R
from marlstone.operators import statespace as S


def series(spark, **columns):
    rows = list(zip(*[map(float, c) for c in columns.values()]))
    return spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], ["k", "t", *columns])


def column(df, name):
    return np.array([r[name] for r in df.orderBy("t").select(name).collect()])


def test_kalman_finds_the_line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    out = S.kalman_line(series(spark, x=x, y=2 + 3 * x + 0.01 * rng.normal(size=300)), "x", "y", ["k"], ["t"], drift=1e-6, noise=1e-3)
    assert column(out, "alpha")[-1] == pytest.approx(2, abs=0.05) and column(out, "beta")[-1] == pytest.approx(3, abs=0.05)


def test_regimes_are_told_apart(spark):
    rng = np.random.default_rng(2)
    x, truth = rng.normal(size=400), np.repeat([0, 1, 0, 1], 100)
    y = np.where(truth == 0, 2 + 0.5 * x, 10 - 1.5 * x) + 0.3 * rng.normal(size=400)
    assert (column(R.regime_regression(series(spark, x=x, y=y), ["x"], "y", ["k"], ["t"]), "state") == truth).mean() > 0.98


def test_short_series_give_null(spark):
    out = R.regime_regression(series(spark, x=[1, 2], y=[1, 2]), ["x"], "y", ["k"], ["t"])
    assert out.filter("state IS NOT NULL AND NOT isnan(state)").count() == 0
    assert M.fluctuation_exponents(series(spark, v=[1, 2]), "v", ["k"], ["t"]).first().h is None


def test_noise_has_exponent_one_half(spark):
    h = M.fluctuation_exponents(series(spark, v=np.random.default_rng(3).normal(size=4000)), "v", ["k"], ["t"]).first().h
    assert h[4] == pytest.approx(0.5, abs=0.08)


def test_capped_strategy_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    s, r = rng.normal(scale=8, size=200), rng.normal(size=200)
    out = P.capped_strategy(series(spark, s=s, r=r), "s", "r", ["k"], ["t"], 5.0, 7, 2)
    ends, want = [], []
    for i in range(200):
        ends = [(e, d) for e, d in ends if e > i]
        if abs(s[i]) > 5 and len(ends) < 2:
            ends.append((min(i + 7, 199), np.sign(s[i])))
        want.append(sum(d for _, d in ends) * r[i])
    assert np.allclose(column(out, "pnl"), want)


def test_metaorders_keep_long_runs_of_one_sign(spark):
    score = [0, 9, 8, 9, 8, 9, 9, 0, 0, -9, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    df = series(spark, at=range(20), s=score, g=np.sign(score))
    got = M.metaorders(df, "at", "s", "g", ["k"], ["t"], 0.7, 0.66, 2.0, 5, 5.0).collect()
    assert [(r.t0, r.t1, r.sign, r.n_child) for r in got] == [(1.0, 6.0, 1.0, 6)]

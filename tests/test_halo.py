"""Rolling computations over chunks with a halo against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import fractal, halo, labels, running, series, signals


def frame(spark, series):
    return spark.createDataFrame([(k, t, [float(x) for x in v]) for k, rows in series.items() for t, v in enumerate(rows)], "k string, t int, v array<double>").repartition(3)


def by_key(df, column):
    out = {}
    for r in df.orderBy("t").collect():
        out.setdefault(r.k, []).append(r[column])
    return out


@pytest.mark.parametrize("own", [20, 33, None])
def test_factors_equal_a_decomposition_a_row(spark, own):
    r = np.random.default_rng(1)
    series = {"a": np.cumsum(r.normal(size=(90, 5)), 0) @ r.normal(size=(5, 5)), "b": r.normal(size=(25, 5)), "short": r.normal(size=(4, 5))}
    series["b"][:, 2] = 7.0
    got = by_key(halo.rolling_factors(frame(spark, series), "v", 5, ["k"], ["t"], 20, 3, own), "factors")
    for k, x in series.items():
        want = np.zeros((len(x), 3))
        for t in range(20, len(x)):
            past = x[t - 20 : t]
            s = past.std(0)
            z = (past - past.mean(0)) / np.where(s > 1e-12, s, 1.0)
            axes = np.linalg.svd(z, full_matrices=False)[2][:3]
            want[t] = z[-1] @ (axes * np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]).T
        assert np.allclose(got[k], want, atol=1e-7), k


def ledoit_wolf(x):
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = sum(((np.outer(v, v) - s) ** 2).sum() for v in x) / n**2 / p
    share = min(beta, delta) / delta
    return (1 - share) * s + share * mu * np.eye(p)


@pytest.mark.parametrize("shrink", [True, False])
def test_precision_equals_a_dense_loop(spark, shrink):
    r = np.random.default_rng(2)
    x = r.normal(size=(70, 4)) @ r.normal(size=(4, 4)) + 30
    got = by_key(halo.rolling_precision(frame(spark, {"a": x}), "v", 4, ["k"], ["t"], 25, 1e-3, shrink, 26), "strength")["a"]
    for t in range(70):
        if t < 25:
            assert got[t] is None
            continue
        past = x[t - 25 : t]
        inverse = np.abs(np.linalg.inv((ledoit_wolf(past) if shrink else np.cov(past.T) + 1e-3 * np.eye(4)) + 1e-3 * np.eye(4)))
        assert np.allclose(got[t], inverse.sum(1) - np.diag(inverse))


def rates(e, lags, until):
    n = min(until, len(e))
    if n <= lags + 1:
        rate = np.full(len(e), e[:n].mean())
    else:
        x = np.array([e[t - lags : t][::-1] for t in range(lags, n)])
        a = np.linalg.solve(x.T @ x + 1e-3 * np.eye(lags), x.T @ e[lags:n])
        mu = max(1e-6, e[lags:n].mean() - x.mean(0) @ a)
        rate = np.array([mu if t < lags else max(mu + a @ e[t - lags : t][::-1], 1e-6) for t in range(len(e))])
    return rate, np.diff(rate, prepend=rate[:1])


@pytest.mark.parametrize(("own", "until"), [(12, 10**6), (40, 10**6), (None, 80)])
def test_intensity_equals_a_loop(spark, own, until):
    r = np.random.default_rng(3)
    series = {"a": (r.random((150, 1)) < 0.3).astype(float), "b": r.poisson(1.0, (60, 1)).astype(float), "short": np.ones((7, 1))}
    df = frame(spark, series).withColumn("e", F.col("v")[0])
    out = halo.self_excitation(df, "e", ["k"], ["t"], 8, fit_until=F.col("t") < until, own=own)
    rate, slope = by_key(out, "intensity"), by_key(out, "slope")
    for k, x in series.items():
        want = rates(x[:, 0], 8, until)
        assert np.allclose(rate[k], want[0]) and np.allclose(slope[k], want[1])


def test_running_totals_and_ranks(spark):
    r = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3 if i % 7 else 0], i, float(r.integers(0, 6)) if i % 2 else 2.0, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, v double, part string").repartition(4)
    got = running.row_numbers(running.running_total(df, F.col("v"), ["k"], ["t"], "total"), ["k"], ["t"]).collect()
    assert len(got) == 500 and {x.part for x in got} == {"x"}
    for key in ("a", "b", None):
        mine = [x for x in rows if x[0] == key]
        assert [(x.t, x.total, x.i) for x in sorted((x for x in got if x.k == key), key=lambda x: x.t)] == [(x[1], s, i + 1) for i, (x, s) in enumerate(zip(mine, np.cumsum([x[2] for x in mine])))]
    q = {x.k: x.q for x in running.exact_quantiles(df, "v", ["k"], [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    for key in ("a", "b", None):
        assert np.allclose(q[key], np.quantile([x[2] for x in rows if x[0] == key], [0.0, 0.1, 0.5, 0.77, 1.0]))
    assert running.exact_quantiles(df.limit(0), "v", ["k"], [0.5]).count() == 0


def test_exponents_of_known_walks(spark):
    r = np.random.default_rng(5)
    noise = r.normal(size=1200)
    rows = [("noise", i, v) for i, v in enumerate(noise)] + [("flat", i, 1.0) for i in range(400)] + [("trend", i, v) for i, v in enumerate(np.cumsum(noise))] + [("short", i, 1.0 * i) for i in range(256)]
    got = fractal.window_exponents(spark.createDataFrame([(k, i, float(v)) for k, i, v in rows], "k string, t int, v double"), "v", ["k"], ["t"]).collect()
    of = lambda k: [x for x in got if x.k == k]
    assert len(of("noise")) == 16 and not of("short") and [x.t for x in sorted(of("noise"), key=lambda x: x.window)][:2] == [255, 315]
    assert np.mean([x.h[4] for x in of("noise")]) == pytest.approx(0.5, abs=0.1) and np.mean([x.h[4] for x in of("trend")]) > 1.2
    assert {x.regime for x in of("flat")} == {"insufficient"} and {x.regime for x in of("trend")} == {"strong trend"}


@pytest.mark.parametrize(("horizon", "own"), [(5, 7), (13, 13), (64, 70), (2700, None)])
def test_barriers_equal_a_loop(spark, horizon, own):
    r = np.random.default_rng(horizon)
    series = {"a": 100 * np.exp(np.cumsum(0.02 * r.normal(size=160))), "b": 50 + r.normal(size=40), "flat": np.full(9, 7.0), "one": np.ones(1)}
    sigma = {k: np.where(r.random(len(v)) < 0.6, 0.01 * (1 + r.random(len(v))), np.nan) for k, v in series.items()}
    series["b"][5], series["b"][20] = np.nan, 0.0
    none = lambda x: None if np.isnan(x) else float(x)
    df = spark.createDataFrame([(k, i, none(x), none(s)) for k, v in series.items() for i, (x, s) in enumerate(zip(v, sigma[k]))], "k string, t int, v double, s double")
    got = {(x.k, x.t): x for x in labels.triple_barrier(df, "v", "s", ["k"], ["t"], 2.0, 1.5, horizon, own).collect()}
    assert len(got) == len(df.collect())
    for k, v in series.items():
        known = np.nan
        for i, x in enumerate(v):
            known = sigma[k][i] if not np.isnan(sigma[k][i]) else known
            ahead = range(i + 1, min(i + horizon, len(v) - 1) + 1)
            a = next((j for j in ahead if v[j] >= x * (1 + 2 * known)), None)
            b = next((j for j in ahead if v[j] <= x * (1 - 1.5 * known)), None)
            above = a is not None and (b is None or a < b or a == b == i + 1)
            hit = a if above else b if b is not None else ahead[-1] if ahead else None
            row = got[k, i]
            assert row.label == (1 if above else -1 if b is not None else 0) and row.t_hit == hit
            want = v[hit] / x - 1 if hit is not None and x != 0 else np.nan
            assert (row.ret is None) == bool(np.isnan(want)) and (row.ret is None or abs(row.ret - want) < 1e-9)


def test_winsorised_keys(spark):
    rows = [("a", float(i)) for i in range(11)] + [(None, float(i)) for i in range(21)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = sorted(((r.k, r.v, r.clipped) for r in series.winsorize(df, "v", ["k"], 0.1, 0.9).collect()), key=repr)
    clip = {"a": (1.0, 9.0), None: (2.0, 18.0)}
    assert got == sorted(((k, v, None if v is None else min(max(v, clip[k][0]), clip[k][1])) for k, v in rows), key=repr)
    q = {r.k: (r.n, r.q50) for r in signals.quantiles(df, "v", ["k"]).collect()}
    assert q == {"a": (11, 5.0), None: (21, 10.0), "none": (0, None)}

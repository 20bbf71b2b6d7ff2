"""Scans over chunks against plain loops over whole series."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunks, regimes, statespace


def frame(spark, series, names):
    """(k, t, names...) from {key: rows}; NaN as null."""
    rows = [(k, t, *[None if np.isnan(v) else float(v) for v in r]) for k, rows in series.items() for t, r in enumerate(rows)]
    return spark.createDataFrame(rows, f"k string, t int, {', '.join(f'{n} double' for n in names)}").repartition(3)


def by_key(df):
    out = {}
    for r in df.orderBy("t").collect():
        out.setdefault(r.k, []).append(r)
    return out


def walk(n, seed, gaps=True):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    a, b = 2 + np.cumsum(0.05 * r.normal(size=n)), -1 + np.cumsum(0.1 * r.normal(size=n))
    y = a + b * x + 0.3 * r.normal(size=n)
    if gaps:
        y[::11], x[5::17] = np.nan, np.nan
    return np.column_stack([x, y])


def loop(rows, q, r, prior):
    """(filtered means and covariances, smoothed ones, lag covariances, log likelihood) of a whole series."""
    n, m, p, ll = len(rows), np.zeros(2), np.eye(2) * prior, 0.0
    ms, ps, ahead = [], [], []
    for x, y in rows:
        p = p + np.diag(q)
        h = np.array([1.0, x])
        ahead.append(h @ m)
        if np.isfinite(x) and np.isfinite(y):
            s = h @ p @ h + r
            k = p @ h / s
            ll -= 0.5 * (np.log(2 * np.pi * s) + (y - h @ m) ** 2 / s)
            m, p = m + k * (y - h @ m), p - np.outer(k, h @ p)
        ms.append(m)
        ps.append(p)
    sm, sp, lag = [ms[-1]], [ps[-1]], []
    for t in range(n - 2, -1, -1):
        e = ps[t] @ np.linalg.inv(ps[t] + np.diag(q))
        lag.append(sp[-1] @ e.T)
        sm.append(ms[t] + e @ (sm[-1] - ms[t]))
        sp.append(ps[t] + e @ (sp[-1] - ps[t] - np.diag(q)) @ e.T)
    return np.array(ms), np.array(ps), np.array(sm[::-1]), np.array(sp[::-1]), np.array(lag[::-1]), ll, np.array(ahead)


def fit(rows, rounds, prior):
    scale = np.nanvar(rows[:, 1])
    q, r = np.full(2, 1e-3 * scale), scale
    for _ in range(rounds):
        _, _, m, p, lag, _, _ = loop(rows, q, r, prior * scale)
        seen = np.isfinite(rows).all(1)
        h = np.column_stack([np.ones(len(rows)), rows[:, 0]])
        r_new = np.mean([(rows[t, 1] - h[t] @ m[t]) ** 2 + h[t] @ p[t] @ h[t] for t in np.flatnonzero(seen)])
        q = np.mean([(m[t + 1] - m[t]) ** 2 + np.diag(p[t + 1] + p[t] - 2 * lag[t]) for t in range(len(rows) - 1)], axis=0)
        r = r_new
    return q, r, loop(rows, q, r, prior * scale)


@pytest.mark.parametrize(("size", "rounds"), [(7, 0), (7, 3), (1000, 3), (1, 1)])
def test_walking_regression_equals_a_loop(spark, size, rounds):
    series = {"a": walk(150, 1), "b": walk(40, 2), "one": walk(1, 3, gaps=False), "none": np.full((3, 2), np.nan)}
    out = by_key(statespace.walking_regression(frame(spark, series, ["x", "y"]), ["x"], "y", ["k"], ["t"], rounds=rounds, prior=100.0, rows=size))
    assert {k: len(v) for k, v in out.items()} == {k: len(v) for k, v in series.items()}
    for k in ("a", "b", "one"):
        q, r, (m, p, sm, sp, _, ll, ahead) = fit(series[k], rounds if k != "one" else 0, 100.0) if k != "one" else (None, None, (None,) * 7)
        if k == "one":
            assert all(np.isfinite(v) for v in out[k][0].coef)
            continue
        got = out[k]
        assert np.allclose([g.filtered for g in got], m) and np.allclose([g.coef for g in got], sm)
        assert np.allclose([g.coef_sd for g in got], np.sqrt(np.diagonal(sp, axis1=1, axis2=2))) and np.allclose([g.filtered_sd for g in got], np.sqrt(np.diagonal(p, axis1=1, axis2=2)))
        assert got[0].noise == pytest.approx(r) and np.allclose(got[0].drift, q) and got[0].loglik == pytest.approx(ll)
        assert np.allclose(np.array([g.ahead for g in got], float), ahead, equal_nan=True)
    assert all(v == 0.0 for r in out["none"] for v in r.coef)


def test_fitted_variances_are_those_that_made_the_series(spark):
    rows = walk(3000, 5, gaps=False)
    one = by_key(statespace.walking_regression(frame(spark, {"a": rows}, ["x", "y"]), ["x"], "y", ["k"], ["t"], rounds=25, drift=3e-4, noise=0.01, rows=500))["a"][0]
    assert one.noise == pytest.approx(0.09, rel=0.2) and 0.001 < one.drift[0] < 0.006 and 0.005 < one.drift[1] < 0.02


def test_forecasts_cover_what_comes(spark):
    rows = walk(600, 9, gaps=False)
    hidden = rows.copy()
    hidden[560:, 1] = np.nan
    out = by_key(statespace.walking_regression(frame(spark, {"a": hidden}, ["x", "y"]), ["x"], "y", ["k"], ["t"], rounds=10, drift=1e-2, noise=0.1, rows=100))["a"]
    inside = [abs(r.fitted - y) <= 1.96 * r.fitted_sd for r, y in zip(out[560:], rows[560:, 1])]
    assert np.mean(inside) > 0.85 and out[599].coef_sd[0] > out[560].coef_sd[0]


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([("a", i, float(i), 2.0 * i, i, "r", i) for i in range(9)], "chunk string, t int, x double, y double, place int, rows string, coef int")
    out = statespace.kalman_line(df, "x", "y", ["chunk"], ["t"], rows=4)
    assert out.columns == [*df.columns, "alpha", "beta", "alpha_sd", "beta_sd"]
    assert [(r.place, r.coef) for r in out.orderBy("t").collect()] == [(i, i) for i in range(9)] and statespace.kalman_line(df.limit(0), "x", "y", ["chunk"], ["t"]).count() == 0
    assert statespace.kalman_line(df.withColumn("t", F.col("t") + 5), "x", "y", [], ["t"]).count() == 9


# -- regimes


def switching(n, seed, k=2):
    r = np.random.default_rng(seed)
    state, out, truth = 0, [], []
    for _ in range(n):
        if r.random() < 0.06:
            state = int(r.integers(k))
        x = r.normal()
        out.append((x, (-2, 3, 9)[state] + (1.5, -1, 0.5)[state] * x + 0.4 * r.normal()))
        truth.append(state)
    return np.array(out), truth


def forward_backward(like, move, start):
    n, k = like.shape
    a, b, ahead, ll = np.empty((n, k)), np.ones((n, k)), np.empty((n, k)), 0.0
    for t in range(n):
        ahead[t] = start if t == 0 else a[t - 1] @ move
        p = ahead[t] * like[t]
        ll += np.log(p.sum())
        a[t] = p / p.sum()
    for t in range(n - 2, -1, -1):
        p = move @ (like[t + 1] * b[t + 1])
        b[t] = p / p.sum()
    g = a * b / (a * b).sum(1, keepdims=True)
    both = np.zeros((k, k))
    for t in range(1, n):
        x = a[t - 1][:, None] * move * (like[t] * b[t])[None, :]
        both += x / x.sum()
    return ahead, a, g, both, ll


def regimes_by_loop(rows, k, rounds, ridge=1e-6):
    from statistics import NormalDist

    x, y = np.column_stack([np.ones(len(rows)), rows[:, 0]]), rows[:, 1]
    eye = ridge * np.eye(2)
    line = np.linalg.solve(x.T @ x + eye, x.T @ y)
    z = (y - x @ line) / np.sqrt(np.mean((y - x @ line) ** 2))
    w = np.exp(-2 * (z[:, None] - [NormalDist().inv_cdf((i + 0.5) / k) for i in range(k)]) ** 2) + 1e-6
    w /= w.sum(1, keepdims=True)
    move, start = np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), np.full(k, 1 / k)

    def lines(w):
        coef = np.array([np.linalg.solve((x * v[:, None]).T @ x + eye, (x * v[:, None]).T @ y) for v in w.T])
        return coef, np.array([max(np.sqrt((v * (y - x @ c) ** 2).sum() / v.sum()), 1e-6) for v, c in zip(w.T, coef)])

    coef, sd = lines(w)
    ll = 0.0
    like = lambda: np.exp(-0.5 * ((y[:, None] - x @ coef.T) / sd) ** 2) / sd / np.sqrt(2 * np.pi)
    for _ in range(rounds):
        _, _, g, both, ll = forward_backward(like(), move, start)
        coef, sd = lines(g)
        both += 1e-12
        move, start = both / both.sum(1, keepdims=True), g[0]
    order = np.argsort(coef @ x.mean(0))
    coef, sd, move, start = coef[order], sd[order], move[np.ix_(order, order)], start[order]
    return like(), move, start, ll, x @ coef.T


@pytest.mark.parametrize(("size", "k", "rounds"), [(13, 2, 5), (50, 3, 4), (5000, 2, 5)])
def test_regimes_equal_a_loop(spark, size, k, rounds):
    series = {"a": switching(300, 1, k)[0], "b": switching(90, 2, k)[0], "short": switching(4, 3)[0]}
    out = by_key(regimes.markov_regression(frame(spark, series, ["x", "y"]), ["x"], "y", ["k"], ["t"], states=k, rounds=rounds, rows=size))
    for key in ("a", "b"):
        like, move, start, ll, means = regimes_by_loop(series[key], k, rounds)
        ahead, now, smooth, _, _ = forward_backward(like, move, start)
        got = out[key]
        for name, want in (("p_ahead", ahead), ("p_filtered", now), ("p_smoothed", smooth)):
            assert np.allclose([g[name] for g in got], want, atol=1e-6), name
        assert got[0].loglik == pytest.approx(ll) and np.allclose([g.guess for g in got], (ahead * means).sum(1), atol=1e-5) and np.allclose([g.fitted for g in got], (smooth * means).sum(1), atol=1e-5)
    assert len(out["short"]) == 4 and all(r.state is None and r.p_ahead == [None] * k for r in out["short"])


@pytest.mark.parametrize("size", [1, 3, 4, 100])
def test_likeliest_path_beats_every_other(spark, size):
    series = {str(i): np.concatenate([switching(9, i)[0], np.full((1, 2), np.nan) if i % 2 else switching(1, 50)[0]]) for i in range(4)}
    series = {k: v if np.isfinite(v).all() else np.column_stack([np.nan_to_num(v[:, 0]), v[:, 1]]) for k, v in series.items()}
    model = regimes.Regimes(2, 2, 1e-6, 1e-4)
    p = (np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([0.6, 0.4]), np.array([[-2.0, 1.5], [3.0, -1.0]]), np.array([2.0, 2.5]), np.array([1.0, 0.0]), 0.0, 0.0, 0, 1, 1)
    cut = chunks.Chunks(frame(spark, series, ["x", "y"]), [F.lit(1.0), F.col("x"), F.col("y"), F.lit(1.0)], ["k"], ["t"], size)
    state = cut.step(None, lambda data, s: chunks.pack(*p), lambda sums: sums)
    out = by_key(cut.rows_with(cut.step(state, model.decoded, model.paths), model.rows, regimes.ADDED))
    for k, rows in series.items():
        x = np.column_stack([np.ones(len(rows)), rows[:, 0]])
        logs = np.where(np.isfinite(rows[:, 1:]), -0.5 * ((rows[:, 1:] - x @ p[2].T) / p[3]) ** 2 - np.log(p[3]), 0.0)
        score = lambda way: np.log(p[1][way[0]]) + sum(logs[t, s] for t, s in enumerate(way)) + sum(np.log(p[0][a, b]) for a, b in zip(way, way[1:]))
        assert tuple(int(r.path) for r in out[k]) == max(itertools.product((0, 1), repeat=len(rows)), key=score)


def test_walk_forward_knows_no_later_row(spark):
    rows, truth = switching(400, 7, 2)
    later = rows.copy()
    later[390:, 1] += 50
    run = lambda v: by_key(regimes.walk_forward(frame(spark, {"a": v}, ["x", "y"]), ["x"], "y", ["k"], ["t"], states=2, rounds=20, intercept=True))["a"]
    a, b = run(rows), run(later)
    assert [r.is_train for r in a] == [i < 280 for i in range(400)]
    assert np.allclose([r.guess for r in a[:391]], [r.guess for r in b[:391]])
    assert np.mean([int(r.path) == s for r, s in zip(a, truth)]) > 0.97 and np.mean([int(r.path) == s for r, s in list(zip(a, truth))[280:]]) > 0.95


def test_walk_forward_keeps_every_series_and_sorts_none_in_one_task(spark):
    rows, _ = switching(60, 7, 2)
    df = frame(spark, {"a": rows, "b": rows[:1]}, ["x", "y"]).unionByName(frame(spark, {"c": rows[:40]}, ["x", "y"]).withColumn("k", F.lit(None).cast("string")))
    found = regimes.walk_forward(df, ["x"], "y", ["k"], ["t"], states=2, rounds=2, intercept=True)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = by_key(found)
    assert {k: len(v) for k, v in got.items()} == {"a": 60, "b": 1, None: 40}
    assert got["b"][0].guess is None and not got["b"][0].is_train
    assert sum(r.is_train for r in got[None]) == 28 and all(r.guess is not None for r in got[None])


def test_chunks_are_dealt_out(spark):
    """Two long series: the passes have no task with most of the rows."""
    rows = spark.range(40000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.rand(1).alias("v"))
    made = chunks.Chunks(rows, [F.col("v")], ["k"], ["t"], 100)
    sizes = [r.n for r in made.packed.groupBy(F.input_file_name()).agg(F.sum(F.size("data")).alias("n")).collect()]
    assert len(sizes) == made.shares and max(sizes) < 0.4 * 40000


def test_means_and_variances_that_switch(spark):
    r = np.random.default_rng(3)
    y = np.concatenate([r.normal(0, 1, 150), r.normal(6, 0.3, 150)])
    out = by_key(regimes.markov_regression(frame(spark, {"a": np.column_stack([y, y])}, ["x", "y"]), [], "y", ["k"], ["t"], rows=40))["a"]
    assert [int(v.path) for v in out] == [0] * 150 + [1] * 150

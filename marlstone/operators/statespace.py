"""Regressions whose coefficients walk at random: filtered, smoothed, and with variances fitted by expectation maximisation.

y = x . c + noise, and c moves by independent normal steps from row to row. Each row is a Gaussian transition from the
coefficients before it to those after it, with the likelihood of what it saw; such transitions compose, so a series is
worked out chunk by chunk (see chunks).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.chunks import Chunks, pack, reduced, unpack

T = lambda m: np.swapaxes(m, -1, -2)


def observed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, seen): rows without all of x and y have x and y 0 where they are used."""
    x, y = data[:, :-1], data[:, -1]
    return x, y, np.isfinite(data).all(1)


def composed(a, b):
    """The transition that does a and then b. A transition is (A, b, C, eta, J): from c to A c + b with covariance C, and the information that it has on c."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = a, b
    turn = np.linalg.inv(np.eye(a1.shape[-1]) + c1 @ j2)
    on, back = a2 @ turn, T(turn @ a1)
    vec = lambda m, v: (m @ v[..., None])[..., 0]
    cov, info = on @ c1 @ T(a2) + c2, back @ j2 @ a1 + j1
    return on @ a1, vec(on, b1 + vec(c1, e2)) + b2, (cov + T(cov)) / 2, vec(back, e2 - vec(j2, b1)) + e1, (info + T(info)) / 2


def transition(data: np.ndarray, noise: float, drift: np.ndarray):
    """The transition of a whole chunk."""
    x, y, seen = observed(data)
    x, y = np.where(seen[:, None], x, 0.0), np.where(seen, y, 0.0)
    size, eye = (x * x) @ drift + noise, np.eye(x.shape[1])
    gain = x * drift / size[:, None]
    left = eye - gain[:, :, None] * x[:, None, :]
    return tuple(e[0] for e in reduced((left, gain * y[:, None], left * drift, x * (y / size)[:, None], x[:, :, None] * x[:, None, :] / size[:, None, None]), composed))


def filtered(data, noise, drift, mean, cov):
    """(means, covariances, log likelihood, forecasts, their variances): one mean and covariance more than rows, the first being what the chunk begins with."""
    x, y, seen = observed(data)
    n, d = x.shape
    means, covs, ahead, spread, ll = np.empty((n + 1, d)), np.empty((n + 1, d, d)), np.full(n, np.nan), np.full(n, np.nan), 0.0
    means[0], covs[0], step, known = mean, cov, np.diag(drift), np.isfinite(x).all(1)
    for t in range(n):
        cov = cov + step
        if known[t]:
            h = x[t]
            ph = cov @ h
            ahead[t], spread[t] = h @ mean, h @ ph + noise
            if seen[t]:
                gap = y[t] - ahead[t]
                mean, cov = mean + ph * (gap / spread[t]), cov - np.outer(ph, ph) / spread[t]
                ll -= 0.5 * (math.log(2 * math.pi * spread[t]) + gap * gap / spread[t])
        means[t + 1], covs[t + 1] = mean, cov
    return means, covs, ll, ahead, spread


def smoothed(means, covs, drift, eta, info):
    """(means, covariances, covariances of each row with the one before it), given the information of all later rows."""
    turn = np.linalg.inv(np.eye(len(drift)) + covs[-1] @ info)
    m, c = means.copy(), covs.copy()
    m[-1], c[-1] = turn @ (means[-1] + covs[-1] @ eta), turn @ covs[-1]
    wider = covs[:-1] + np.diag(drift)
    back = covs[:-1] @ np.linalg.inv(wider)
    for t in range(len(m) - 2, -1, -1):
        m[t] = means[t] + back[t] @ (m[t + 1] - means[t])
        c[t] = covs[t] + back[t] @ (c[t + 1] - wider[t]) @ back[t].T
    return m, c, c[1:] @ T(back)


class RandomWalk:
    """The steps of the scan for d coefficients. Parameters of a series: noise, drift (d), scale (the variance of y), log likelihood."""

    def __init__(self, d: int, drift: float, noise: float, prior: float):
        self.d, self.drift, self.noise, self.prior = d, drift, noise, prior
        self.shapes = [(), (d,), (), ()]

    # The variance of y, chunk by chunk: count, mean, sum of squares about it.
    def spread(self, data, _):
        y = data[np.isfinite(data[:, -1]), -1]
        return pack(len(y), y.mean() if len(y) else 0.0, ((y - y.mean()) ** 2).sum() if len(y) else 0.0)

    def first(self, sums):
        n = sum(s[0] for s in sums)
        mean = sum(s[0] * s[1] for s in sums) / n if n else 0.0
        scale = sum(s[2] + s[0] * (s[1] - mean) ** 2 for s in sums) / n if n else 1.0
        scale = scale if scale > 0 else 1.0
        return [pack(self.noise * scale, np.full(self.d, self.drift * scale), scale, 0.0)] * len(sums)

    def total(self, data, s):
        noise, drift, _, _ = unpack(s, *self.shapes)
        return pack(s, *transition(data, noise, drift))

    def ends(self, sums):
        """What each chunk begins with and what all later ones know of the coefficients at its end."""
        d, known = self.d, len(sums[0]) - (3 * self.d * self.d + 2 * self.d)
        parts = [unpack(s[known:], (d, d), (d,), (d, d), (d,), (d, d)) for s in sums]
        eye, mean, cov, out = np.eye(d), np.zeros(d), np.eye(d) * self.prior * unpack(sums[0], *self.shapes)[2], []
        for a, b, c, e, j in parts:
            out.append([mean, cov])
            turn = a @ np.linalg.inv(eye + cov @ j)
            mean, cov = turn @ (mean + cov @ e) + b, turn @ cov @ a.T + c
            cov = (cov + cov.T) / 2
        eta, info = np.zeros(d), np.zeros((d, d))
        for i in range(len(parts) - 1, -1, -1):
            out[i] += [eta, info]
            a, b, c, e, j = parts[i]
            back = a.T @ np.linalg.inv(eye + info @ c)
            eta, info = back @ (eta - info @ b) + e, back @ info @ a + j
            info = (info + info.T) / 2
        return [pack(s[:known], i == 0, *o) for i, (s, o) in enumerate(zip(sums, out))]

    def worked(self, data, s):
        noise, drift, _, _, begins, mean, cov, eta, info = unpack(s, *self.shapes, (), (self.d,), (self.d, self.d), (self.d,), (self.d, self.d))
        means, covs, ll, ahead, spread = filtered(data, noise, drift, mean, cov)
        return bool(begins), means, covs, ll, ahead, spread, *smoothed(means, covs, drift, eta, info)

    def moments(self, data, s):
        """Sums over the smoothed coefficients for the variances: rows seen, squared residuals, steps, squared steps, log likelihood."""
        x, y, seen = observed(data)
        begins, _, _, ll, _, _, m, c, lagged = self.worked(data, s)
        x, y, own, cov = x[seen], y[seen], m[1:][seen], c[1:][seen]
        left = ((y - (x * own).sum(1)) ** 2).sum() + np.einsum("ti,tij,tj->", x, cov, x)
        diag = lambda a: np.diagonal(a, axis1=1, axis2=2)
        steps = ((m[1:] - m[:-1]) ** 2 + diag(c[1:]) + diag(c[:-1]) - 2 * diag(lagged))[int(begins) :]
        return pack(s[: self.d + 3], len(y), left, len(steps), steps.sum(0), ll)

    def fitted(self, sums):
        d = self.d
        noise, drift, scale, _ = unpack(sums[0], *self.shapes)
        n, left, steps, squares, ll = unpack(sum(s[d + 3 :] for s in sums), (), (), (), (d,), ())
        floor = 1e-12 * scale
        return [pack(max(left / n, floor) if n else noise, np.maximum(squares / steps, floor * 1e-3) if steps else drift, scale, ll)] * len(sums)

    def likelihood(self, data, s):
        return pack(s, self.worked(data, s)[3])

    def totals(self, sums):
        ll = sum(s[-1] for s in sums)
        return [pack(s[: self.d + 2], ll, s[self.d + 3 : -1]) for s in sums]

    def rows(self, data, s):
        noise, drift, _, ll = unpack(s, *self.shapes)
        x = data[:, :-1]
        _, means, covs, _, ahead, spread, m, c, _ = self.worked(data, s)
        sd = lambda a: np.sqrt(np.maximum(np.diagonal(a[1:], axis1=1, axis2=2), 0.0))
        fit, wide = (x * m[1:]).sum(1), np.einsum("ti,tij,tj->t", x, c[1:], x) + noise
        n = len(data)
        return {
            "filtered": means[1:], "filtered_sd": sd(covs), "coef": m[1:], "coef_sd": sd(c), "ahead": ahead, "ahead_sd": np.sqrt(spread), "fitted": fit, "fitted_sd": np.sqrt(np.maximum(wide, 0.0)),
            "noise": np.full(n, noise), "drift": np.tile(drift, (n, 1)), "loglik": np.full(n, ll),
        }


ADDED = {"filtered": "array<double>", "filtered_sd": "array<double>", "coef": "array<double>", "coef_sd": "array<double>", "ahead": "double", "ahead_sd": "double", "fitted": "double", "fitted_sd": "double", "noise": "double", "drift": "array<double>", "loglik": "double"}


def walking_regression(df: DataFrame, features: Sequence[str], y: str, keys, order, *, intercept: bool = True, rounds: int = 0, drift: float = 1e-3, noise: float = 1.0, prior: float = 1e6, rows: int | None = None) -> DataFrame:
    """Adds, for coefficients of [1, *features]: filtered and filtered_sd (given the rows so far), coef and coef_sd (smoothed, given the whole series), ahead and ahead_sd (the forecast of y from the rows before), fitted and fitted_sd (of y, from the smoothed coefficients), noise and drift (the variances used), loglik.

    Given the variances these are the exact moments of the normal posterior: coef +- 1.96 coef_sd holds 95 % of it, and rows
    with a null y, such as those to be forecast, get its predictive moments in fitted and fitted_sd. `drift` and `noise` are
    variances in units of the series' variance of y; `rounds` rounds of expectation maximisation fit them, a drift for each
    coefficient. The coefficients begin around 0 with a variance of `prior` in the same unit. A row without y or a feature
    only widens; without a feature its forecasts are null. rows: rows a chunk, by default the square root of all.
    """
    numbers = [*([F.lit(1.0)] if intercept else []), *map(F.col, features), F.col(y)]
    model, chunks = RandomWalk(len(numbers) - 1, drift, noise, prior), Chunks(df, numbers, keys, order, rows)
    state = chunks.step(None, model.spread, model.first)
    for _ in range(rounds):
        state = chunks.step(chunks.step(state, model.total, model.ends), model.moments, model.fitted)
    state = chunks.step(chunks.step(state, model.total, model.ends), model.likelihood, model.totals)
    return chunks.rows_with(state, model.rows, ADDED)


def kalman_line(df: DataFrame, x: str, y: str, keys, order, drift: float = 1e-3, noise: float = 1.0, prior: float = 1e6, rows: int | None = None) -> DataFrame:
    """Adds alpha, beta and their sds: y = alpha + beta * x with coefficients that walk at random, filtered; `drift` and `noise` are variances relative to y's. A row without x or y only widens the sds."""
    found = walking_regression(df.select(F.struct("*").alias("_row"), *dict.fromkeys([*keys, *order, x, y])), [x], y, keys, order, drift=drift, noise=noise, prior=prior, rows=rows)
    return found.select("_row.*", *[F.col(c)[i].alias(n) for c, names in (("filtered", ("alpha", "beta")), ("filtered_sd", ("alpha_sd", "beta_sd"))) for i, n in enumerate(names)])

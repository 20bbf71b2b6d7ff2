"""Regressions under a hidden Markov chain: fitted by expectation maximisation, filtered, smoothed, decoded and forecast.

Which of k states holds is a chain; each state has a linear regression of its own. The rows of a chunk act on the k states
as a k x k matrix: of probabilities for filtering and smoothing, of best log scores for the likeliest path. Such matrices
compose, so a series is worked out chunk by chunk (see chunks).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stored import remove, stored
from marlstone.operators.chunks import SHARE, Chunks, pack, reduced, unpack
from marlstone.operators.running import row_numbers

#: Rows at most of series that are fitted side by side, and rows of these at once.
SHORT, SIDE = 1024, 1 << 18


def times(a, b):
    """Products of matrices held as (matrix, log of what was taken out)."""
    m = a[0] @ b[0]
    top = np.maximum(over(np.maximum, m.reshape(len(m), -1)), 1e-300)
    return m / top[:, None, None], a[1] + b[1] + np.log(top)


def best(a, b):
    """Products in which scores add up and the best way through counts."""
    return ((a[0][..., :, :, None] + b[0][..., None, :, :]).max(-2),)


def over(states, p: np.ndarray) -> np.ndarray:
    """states (np.add, np.maximum) over the last axis, which is short: faster than numpy's own reductions of such."""
    out = p[..., 0]
    for i in range(1, p.shape[-1]):
        out = states(out, p[..., i])
    return out


def log_of(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-300))


def passes(steps: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(now, later), one more than steps: now from `first` on times step after step, each made to sum to 1; later from `after` at the end back, step times what follows, each made to have 1 as its greatest.

    A scan in two levels within a chunk too: all its pieces go step by step together, so Python's steps are of the order of
    the square root of the chunk.
    """
    n, k = len(steps), len(first)
    length = max(1, math.isqrt(n))
    pieces = -(-n // length)
    whole = np.broadcast_to(np.eye(k), (pieces * length, k, k)).copy()
    whole[:n] = steps
    whole = whole.reshape(pieces, length, k, k)
    share = lambda p: p / np.maximum(over(np.add, p), 1e-300)[..., None]
    top = lambda p: p / np.maximum(over(np.maximum, p), 1e-300)[..., None]
    product = np.broadcast_to(np.eye(k), (pieces, k, k))
    for i in range(length):
        product = product @ whole[:, i]
        product = product / np.maximum(over(np.maximum, product.reshape(pieces, k * k)), 1e-300)[:, None, None]
    begin, final = np.empty((pieces, k)), np.empty((pieces, k))
    p = share(first)
    for j in range(pieces):
        begin[j], p = p, share(p @ product[j])
    p = after
    for j in range(pieces - 1, -1, -1):
        final[j], p = p, top(product[j] @ p)
    now, later = np.empty((pieces, length, k)), np.empty((pieces, length, k))
    p, q = begin, final
    for i in range(length):
        p = share((p[:, None, :] @ whole[:, i])[:, 0])
        now[:, i] = p
    for i in range(length - 1, -1, -1):
        q = top((whole[:, i] @ q[:, :, None])[:, :, 0])
        later[:, i] = q
    return np.concatenate([share(first)[None], now.reshape(-1, k)[:n]]), np.concatenate([later.reshape(-1, k)[:n], after[None]])


class Regimes:
    """The steps of the scan. Parameters of a series: move (k, k), start (k), coef (k, d), sd (k), means of the features (d), log likelihood, the one before it, rounds done, whether it has converged, whether there are rows enough."""

    def __init__(self, k: int, d: int, ridge: float, tol: float):
        self.k, self.d, self.ridge, self.tol = k, d, ridge, tol
        self.shapes = [(k, k), (k,), (k, d), (k,), (d,), (), (), (), (), ()]
        self.size = sum(math.prod(s) for s in self.shapes)

    def parts(self, s):
        return unpack(s, *self.shapes)

    def split(self, data, fitting=True):
        """(x, y, seen): what of a chunk may tell the states apart; rows that are not fitted on tell nothing while fitting."""
        x, y = data[:, : self.d], data[:, self.d]
        return x, y, np.isfinite(data[:, : self.d + 1]).all(1) & ((data[:, self.d + 1] == 1) if fitting else True)

    def likelihoods(self, s, data, fitting):
        """(likelihoods of the states row by row, scaled by each row's best; logs of the scales)."""
        _, _, coef, sd, *_ = self.parts(s)
        x, y, seen = self.split(data, fitting)
        logs = np.zeros((len(x), self.k))
        logs[seen] = -0.5 * ((y[seen, None] - x[seen] @ coef.T) / sd) ** 2 - np.log(sd) - 0.5 * math.log(2 * math.pi)
        top = over(np.maximum, logs)
        return np.exp(logs - top[:, None]), top

    # -- starting values: least squares, then shares of the states by where a residual lies

    def products(self, data, _):
        x, y, seen = self.split(data)
        x, y = x[seen], y[seen]
        return pack(len(y), x.sum(0), x.T @ x, x.T @ y, y @ y)

    def line(self, sums):
        n, sx, xx, xy, yy = unpack(sum(sums), (), (self.d,), (self.d, self.d), (self.d,), ())
        coef = np.linalg.solve(xx + self.ridge * np.eye(self.d), xy)
        sd = math.sqrt(max(yy - 2 * coef @ xy + coef @ xx @ coef, 0.0) / max(n, 1))
        return [pack(coef, max(sd, 1e-6), sx / max(n, 1), n >= max(10, self.k * (self.d + 2)))] * len(sums)

    def shares(self, data, s):
        coef, sd, means, enough = unpack(s, (self.d,), (), (self.d,), ())
        x, y, seen = self.split(data)
        centres = np.array([NormalDist().inv_cdf((i + 0.5) / self.k) for i in range(self.k)])
        w = np.exp(-2.0 * ((y[seen] - x[seen] @ coef)[:, None] / sd - centres) ** 2) + 1e-6
        return pack(means, enough, self.weighed(x[seen], y[seen], w / w.sum(1, keepdims=True)))

    def begin(self, sums):
        means, enough = unpack(sums[0], (self.d,), ())
        coef, sd = self.regressions(sum(s[self.d + 1 :] for s in sums), np.zeros((self.k, self.d)), np.ones(self.k))
        move = np.full((self.k, self.k), 0.1 / self.k) + 0.9 * np.eye(self.k)
        return [pack(move, np.full(self.k, 1 / self.k), coef, sd, means, 0.0, 0.0, 0, not enough, enough)] * len(sums)

    def weighed(self, x, y, w):
        squares = (x[:, :, None] * x[:, None, :]).reshape(len(x), self.d * self.d)
        return pack(w.sum(0), w.T @ squares, w.T @ (x * y[:, None]), w.T @ (y * y))

    def regressions(self, sums, coef, sd):
        n, xx, xy, yy = unpack(sums, (self.k,), (self.k, self.d, self.d), (self.k, self.d), (self.k,))
        coef, sd = coef.copy(), sd.copy()
        for s in range(self.k):
            if n[s] >= 1e-6:
                coef[s] = np.linalg.solve(xx[s] + self.ridge * np.eye(self.d), xy[s])
                sd[s] = max(math.sqrt(max(yy[s] - 2 * coef[s] @ xy[s] + coef[s] @ xx[s] @ coef[s], 0.0) / n[s]), 1e-6)
        return coef, sd

    # -- one round: what each chunk does to the states, what it begins with and what follows, sums for the next parameters

    def matrix(self, data, s, fitting=True):
        like, top = self.likelihoods(s, data, fitting)
        move = self.parts(s)[0]
        steps = move * like[:, None, :]
        steps[0] = np.diag(like[0])
        m, log = reduced((steps, np.zeros(len(steps))), times)
        return m[0], log[0] + top.sum()

    def total(self, data, s):
        if s[self.size - 2]:  # done: no round changes it
            return pack(s[: self.size], np.eye(self.k), 0.0)
        return pack(s[: self.size], *self.matrix(data, s))

    def around(self, sums):
        """For each chunk of a series: (state shares at the end of the one before, likelihoods of all that follows its end), and the log likelihood of the series."""
        move, start, *_ = self.parts(sums[0])
        parts = [unpack(s[self.size :], (self.k, self.k), ()) for s in sums]
        end, ends, ll = None, [], 0.0
        for m, log in parts:
            ends.append(np.zeros(self.k) if end is None else end)
            end = (start if end is None else end @ move) @ m
            ll += log + math.log(max(end.sum(), 1e-300))
            end = end / max(end.sum(), 1e-300)
        after, follows = np.ones(self.k), []
        for m, _ in reversed(parts):
            follows.append(after)
            after = move @ (m @ after)
            after = after / max(after.max(), 1e-300)
        return list(zip(ends, reversed(follows))), ll

    def ends(self, sums):
        around, ll = self.around(sums)
        out = []
        for i, (s, pair) in enumerate(zip(sums, around)):
            p = self.parts(s[: self.size].copy())
            if not p[8]:
                p[6], p[5] = p[5], ll
            out.append(pack(*p, i == 0, *pair))
        return out

    def posteriors(self, data, s, fitting):
        """(forecast, filtered and smoothed shares of the states row by row, sums of the moves)."""
        move, start, *_ = self.parts(s)
        begins, end, after = unpack(s[self.size :], (), (self.k,), (self.k,))
        like, _ = self.likelihoods(s, data, fitting)
        n = len(like)
        first = start if begins else end @ move
        now, later = passes(move * like[1:, None, :], first * like[0], after)
        ahead = np.concatenate([first[None], now[:-1] @ move])
        smooth = now * later
        smooth /= np.maximum(over(np.add, smooth), 1e-300)[:, None]
        before = now[:-1] if begins else np.concatenate([end[None], now[:-1]])
        arrive = (like * later)[len(like) - len(before) :]
        # Of each step's table, before x move x arrive, the sum is that of what it arrives at; the tables themselves need not be made.
        sums = np.maximum(over(np.add, (before @ move) * arrive), 1e-300)
        both = move * (before.T @ (arrive / sums[:, None]))
        return ahead, now, smooth, both

    def moments(self, data, s):
        if s[self.size - 2]:
            return s[: self.size]
        x, y, seen = self.split(data)
        _, _, smooth, both = self.posteriors(data, s, True)
        begins = s[self.size]
        return pack(s[: self.size], smooth[0] if begins else np.zeros(self.k), both, self.weighed(x[seen], y[seen], smooth[seen]))

    def fitted(self, sums):
        p = self.parts(sums[0][: self.size].copy())
        move, start, coef, sd, means, ll, before, rounds, done, enough = p
        if not done:
            total = sum(s[self.size :] for s in sums)
            start, both = unpack(total, (self.k,), (self.k, self.k))
            coef, sd = self.regressions(total[self.k + self.k * self.k :], coef, sd)
            both = both + 1e-12
            move = both / both.sum(1, keepdims=True)
            done = rounds > 5 and abs(ll - before) < self.tol
            rounds += 1
        return [pack(move, start, coef, sd, means, ll, before, rounds, done, enough)] * len(sums)

    # -- all rounds of series that need not be cut

    def fit(self, series: list[np.ndarray], rounds: int) -> list[np.ndarray]:
        """The parameters of each series: short ones side by side, those of about one length together, the others one by one."""
        out, at = [None] * len(series), sorted(range(len(series)), key=lambda i: len(series[i]))
        while at and len(series[at[0]]) <= SHORT:
            n = 1
            while n < len(at) and len(series[at[n]]) <= SHORT and (n + 1) * len(series[at[n]]) <= SIDE:
                n += 1
            for i, s in zip(at[:n], self.side_by_side([series[i] for i in at[:n]], rounds)):
                out[i] = s
            at = at[n:]
        for i in at:
            s = self.begin([self.shares(series[i], self.line([self.products(series[i], None)])[0])])[0]
            for _ in range(rounds):
                if s[self.size - 2]:
                    break
                s = self.fitted([self.moments(series[i], self.ends([self.total(series[i], s)])[0])])[0]
            out[i] = s
        return out

    def lines(self, sums, coef, sd):
        """As regressions(), for the sums of many series: (series, state, ...) with the last axis of x x', x y, y y and 1."""
        d = self.d
        xx, xy, yy, n = sums[..., : d * d].reshape(*sums.shape[:-1], d, d), sums[..., d * d : -2], sums[..., -2], sums[..., -1]
        some = n >= 1e-6
        found = np.linalg.solve(np.where(some[..., None, None], xx + self.ridge * np.eye(d), np.eye(d)), xy[..., None])[..., 0]
        left = yy - 2 * (found * xy).sum(-1) + np.einsum("...i,...ij,...j->...", found, xx, found)
        wide = np.maximum(np.sqrt(np.maximum(left, 0.0) / np.where(some, n, 1.0)), 1e-6)
        return np.where(some[..., None], found, coef), np.where(some, wide, sd)

    def side_by_side(self, series: list[np.ndarray], rounds: int) -> list[np.ndarray]:
        """The same rounds for many short series, filled up to one length with rows that tell nothing: each of Python's steps serves all."""
        b, k, d, size = len(series), self.k, self.d, max(map(len, series))
        data = np.full((b, size, d + 2), np.nan)
        for i, one in enumerate(series):
            data[i, : len(one)] = one
        inside = np.arange(size) < np.array([len(one) for one in series])[:, None]
        seen = np.isfinite(data[..., : d + 1]).all(-1) & (data[..., d + 1] == 1)
        x, y = np.where(seen[..., None], data[..., :d], 0.0), np.where(seen, data[..., d], 0.0)
        terms = np.concatenate([(x[..., :, None] * x[..., None, :]).reshape(b, size, d * d), x * y[..., None], (y * y)[..., None], seen[..., None]], -1)
        # Least squares, then shares of the states by where a residual lies.
        n = seen.sum(1)
        means, enough = x.sum(1) / np.maximum(n, 1)[:, None], n >= max(10, k * (d + 2))
        line, wide = self.lines(terms.sum(1), np.zeros((b, d)), np.full(b, 1e-6))
        centres = np.array([NormalDist().inv_cdf((i + 0.5) / k) for i in range(k)])
        w = np.exp(-2.0 * (((y - np.einsum("bti,bi->bt", x, line)) / wide[:, None])[..., None] - centres) ** 2) + 1e-6
        coef, sd = self.lines(np.matmul((w / w.sum(-1, keepdims=True)).transpose(0, 2, 1), terms), np.zeros((b, k, d)), np.ones((b, k)))
        move, start = np.broadcast_to(np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), (b, k, k)).copy(), np.full((b, k), 1 / k)
        ll, before, done, count = np.zeros(b), np.zeros(b), ~enough, np.zeros(b)
        at = np.flatnonzero(~done)
        for _ in range(rounds):
            if not len(at):
                break
            own = slice(None) if len(at) == b else at
            found = self.one_round(x[own], y[own], seen[own], inside[own], terms[own], move[at], start[at], coef[at], sd[at])
            before[at] = ll[at]
            move[at], start[at], coef[at], sd[at], ll[at] = found
            done[at] = (count[at] > 5) & (np.abs(ll[at] - before[at]) < self.tol)
            count[at] += 1
            at = at[~done[at]]
        return [pack(*p) for p in zip(move, start, coef, sd, means, ll, before, count, done, enough)]

    def one_round(self, x, y, seen, inside, terms, move, start, coef, sd):
        """(move, start, coef, sd, log likelihood before the round) of many series."""
        logs = -0.5 * ((y[..., None] - x @ coef.transpose(0, 2, 1)) / sd[:, None]) ** 2 - np.log(sd)[:, None] - 0.5 * math.log(2 * math.pi)
        logs[~seen] = 0.0
        top = over(np.maximum, logs)
        like = np.ascontiguousarray(np.exp(logs - top[..., None]).transpose(1, 0, 2))
        now, later, scale = np.empty_like(like), np.empty_like(like), np.empty(like.shape[:2])
        p = start
        for t in range(len(like)):
            p = (p if t == 0 else (p[:, :, None] * move).sum(1)) * like[t]
            scale[t] = np.maximum(over(np.add, p), 1e-300)
            now[t] = p = p / scale[t][:, None]
        q = later[-1] = np.ones_like(p)
        for t in range(len(like) - 1, 0, -1):
            q = (move * (like[t] * q)[:, None, :]).sum(2)
            later[t - 1] = q = q / np.maximum(over(np.maximum, q), 1e-300)[:, None]
        smooth = now * later
        smooth /= np.maximum(over(np.add, smooth), 1e-300)[..., None]
        before, arrive = now[:-1].transpose(1, 0, 2), (like * later)[1:].transpose(1, 0, 2)
        arrive = arrive * (inside[:, 1:] / np.maximum(over(np.add, (before @ move) * arrive), 1e-300))[..., None]
        both = move * (before.transpose(0, 2, 1) @ arrive) + 1e-12
        ll = np.where(inside, np.log(scale.T) + top, 0.0).sum(1)
        return both / both.sum(2, keepdims=True), smooth[0], *self.lines(np.matmul(smooth.transpose(1, 2, 0), terms), coef, sd), ll

    # -- with the parameters: all rows, states numbered by rising fitted mean

    def named(self, s):
        move, start, coef, sd, means, *rest = self.parts(s[: self.size])
        order = np.argsort(coef @ means, kind="stable")
        return pack(move[np.ix_(order, order)], start[order], coef[order], sd[order], means, *rest)

    def decoded(self, data, s):
        """What the chunk does to the states, and to the best scores of paths."""
        p = self.named(s)
        like, _ = self.likelihoods(p, data, False)
        logs = log_of(like)
        steps = log_of(self.parts(p)[0]) + logs[:, None, :]
        steps[0] = np.where(np.eye(self.k, dtype=bool), logs[0], -np.inf)
        return pack(p, *self.matrix(data, p, False), np.maximum(reduced((steps,), best)[0][0], -1e300))

    def paths(self, sums):
        """As ends(), with the states that the likeliest path of the series has at the first and last row of each chunk."""
        k = self.k
        around, _ = self.around([s[: self.size + k * k + 1] for s in sums])
        move, start, *_ = self.parts(sums[0])
        scores, entries, exits = [unpack(s[self.size + k * k + 1 :], (k, k))[0] for s in sums], [], []
        come = log_of(start)
        for m in scores:
            entries.append(come)
            exits.append((come[:, None] + m).max(0))
            come = (exits[-1][:, None] + log_of(move)).max(0)
        state, ways = int(exits[-1].argmax()), []
        for i in range(len(scores) - 1, -1, -1):
            first = int((entries[i] + scores[i][:, state]).argmax())
            ways.append((first, state))
            if i:
                state = int((exits[i - 1] + log_of(move)[:, first]).argmax())
        return [pack(s[: self.size], i == 0, *pair, *way) for i, (s, pair, way) in enumerate(zip(sums, around, reversed(ways)))]

    def path(self, data, s, first: int, last: int) -> np.ndarray:
        logs, move = log_of(self.likelihoods(s, data, False)[0]), log_of(self.parts(s)[0])
        score, back = np.where(np.arange(self.k) == first, logs[0], -np.inf), np.zeros((len(logs), self.k), int)
        for t in range(1, len(logs)):
            ways = score[:, None] + move
            back[t], score = ways.argmax(0), ways.max(0) + logs[t]
        out = np.empty(len(logs), int)
        out[-1] = last
        for t in range(len(logs) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def rows(self, data, s):
        _, _, coef, _, _, ll, _, _, _, enough = self.parts(s)
        *_, first, last = s
        n, x = len(data), data[:, : self.d]
        if not enough:
            nothing = np.full(n, np.nan)
            return {c: np.full((n, self.k), np.nan) if c.startswith("p_") else nothing for c in ADDED}
        ahead, now, smooth, _ = self.posteriors(data, s[:-2], False)
        means = x @ coef.T
        return {
            "p_ahead": ahead, "p_filtered": now, "p_smoothed": smooth, "state": smooth.argmax(1).astype(float), "path": self.path(data, s, int(first), int(last)).astype(float),
            "guess": (ahead * means).sum(1), "fitted": (smooth * means).sum(1), "loglik": np.full(n, ll),
        }


ADDED = {"p_ahead": "array<double>", "p_filtered": "array<double>", "p_smoothed": "array<double>", "state": "double", "path": "double", "guess": "double", "fitted": "double", "loglik": "double"}


def markov_regression(df: DataFrame, features: Sequence[str], y: str, keys, order, *, states: int = 2, rounds: int = 80, tol: float = 1e-4, ridge: float = 1e-6, intercept: bool = True, train: Column | None = None, rows: int | None = None) -> DataFrame:
    """Adds p_ahead, p_filtered and p_smoothed (arrays: the states' probabilities given the rows before, the rows so far, and all rows), state (the likeliest by p_smoothed), path (the state on the likeliest path through all rows), guess (the forecast of y from the rows before), fitted (from p_smoothed) and loglik.

    Fitted on the rows where `train` holds, all by default, by at most `rounds` rounds of expectation maximisation, until after six
    the log likelihood moves by less than `tol`; the other rows are told by the parameters so found, each forecast from all values
    of y before it. A row without y or a feature tells nothing of its state. Without features and with an intercept the states
    are means and variances that switch. States are numbered by rising fitted mean. Series with less than ten rows to fit on, or
    states * (coefficients + 2), get nulls. rows: rows a chunk, by default the square root of all. A series of at most a chunk (by
    default, of at most SHARE rows) goes through all rounds in one task; longer ones go through them chunk by chunk, all together.
    """
    numbers = [*([F.lit(1.0)] if intercept else []), *map(F.col, features), F.col(y), F.lit(1.0) if train is None else train.cast("double")]
    model, chunks = Regimes(states, len(numbers) - 2, ridge, tol), Chunks(df, numbers, keys, order, rows)
    short, state = chunks.parted(rows or SHARE)
    short = chunks.whole(short, lambda series: model.fit(series, rounds))
    if state.limit(1).count():
        state = chunks.step(chunks.step(state, model.products, model.line, few=True), model.shares, model.begin, few=True)
        going = F.get("s", F.lit(model.size - 2)) == 0
        for _ in range(rounds):
            if not state.filter(going).limit(1).count():
                break
            state = chunks.step(chunks.step(state, model.total, model.ends, few=True), model.moments, model.fitted, few=True)
    both = stored(short.unionByName(state), "scan")
    remove(short, state)
    state = both
    return chunks.rows_with(chunks.step(state, model.decoded, model.paths), model.rows, ADDED)


def regime_regression(df: DataFrame, features, y: str, keys, order, states: int = 2, rounds: int = 80, tol: float = 1e-4, ridge: float = 1e-6, intercept: bool = True) -> DataFrame:
    """Adds state (the likeliest by smoothed probability; states are numbered by rising fitted mean), p_state, fitted, loglik: markov_regression() for one who only looks back."""
    own = df.select(F.struct("*").alias("_row"), *dict.fromkeys([*keys, *order, *features, y]))
    found = markov_regression(own, features, y, keys, order, states=states, rounds=rounds, tol=tol, ridge=ridge, intercept=intercept)
    told = F.when(F.col(y).isNotNull() & F.forall(F.array(*[F.col(c).isNotNull() for c in features] or [F.lit(True)]), lambda c: c), F.lit(True))
    return found.select("_row.*", *[F.when(told, c).alias(n) for n, c in (("state", F.col("state")), ("p_state", F.array_max("p_smoothed")), ("fitted", F.col("fitted")), ("loglik", F.col("loglik")))])


def walk_forward(df: DataFrame, features: Sequence[str], y: str, keys, order, *, states: int = 3, share: float = 0.7, rounds: int = 80, ridge: float = 1e-3, intercept: bool = False) -> DataFrame:
    """Adds is_train (the first `share` of a series) and the columns of markov_regression(), fitted on those rows alone, on features standardised by their mean and deviation over them: guess on the rest is what could have been known."""
    own = [f"own_{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)]
    numbered = stored(row_numbers(df, keys, order, "_at"), "numbered")
    sizes = numbered.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(F.count("*").alias("_rows"))
    parted = numbered.join(sizes, same).withColumn("is_train", F.col("_at") <= F.floor(share * F.col("_rows"))).drop("_at", "_rows", *own)
    stats = parted.filter("is_train").groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.nullif(F.stddev_pop(c), F.lit(0.0)).alias("sd")).alias(f"f{i}") for i, c in enumerate(features)]).alias("_stats"))
    scaled = parted.join(stats, same, "left").drop(*own).withColumns({f"_z{i}": F.coalesce((F.col(c) - F.col(f"_stats.f{i}.m")) / F.col(f"_stats.f{i}.sd"), F.when(F.col(c).isNotNull(), 0.0)) for i, c in enumerate(features)})
    scaled = stored(scaled.drop("_stats"), "scaled")  # read three times to be cut into chunks
    remove(numbered)
    found = markov_regression(scaled, [f"_z{i}" for i in range(len(features))], y, keys, order, states=states, rounds=rounds, ridge=ridge, intercept=intercept, train=F.col("is_train"))
    remove(scaled)
    return found.drop(*[f"_z{i}" for i in range(len(features))])

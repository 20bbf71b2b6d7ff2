"""Rolling computations that no window function has, over series cut into chunks that carry the rows before them.

A chunk holds its own rows and, ahead of them, as many rows of the chunk before as a window reaches back. So each
chunk is worked out on its own, in one vectorised pass, and a long series is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import cut, joined
from marlstone.functions.stored import stored
from marlstone.operators.running import row_numbers

#: Own rows of a chunk; at least four times the halo, so that the rows carried along add a quarter at most.
OWN = 4096


class Halo:
    """The rows of df per `keys`, in the order of `order`, in chunks with `before` rows of halo ahead and `after` rows behind. vector: an array<double> column of `width` numbers a row, null elements as NaN; with numbered, the row's number in its series, from 0, comes first."""

    def __init__(self, df: DataFrame, vector: Column, width: int, keys: Sequence[str], order: Sequence[str], before: int, own: int | None = None, after: int = 0, numbered: bool = False):
        own = self.own = own or max(OWN, 4 * before, 4 * after)
        if own < max(before, after):
            raise ValueError("a chunk must be at least as long as the halo")
        self.columns, self.width, self.keys = df.columns, width + numbered, [f"key_{i}" for i in range(len(keys))]
        value = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(math.nan)))
        named = df.select(*[F.col(k).alias(n) for k, n in zip(keys, self.keys)], F.struct(*order).alias("at"), value.alias("v"), F.struct("*").alias("row"))
        rows = row_numbers(named, self.keys, ["at"], "i").withColumn("i", F.col("i") - 1)
        if numbered:
            rows = rows.withColumn("v", F.concat(F.array(F.col("i").cast("double")), "v"))
        chunk = F.floor(F.col("i") / own)
        place = lambda c, mine: F.struct(c.alias("chunk"), F.lit(mine).alias("mine"))
        also = [F.when(F.col("i") % own >= own - before, place(chunk + 1, False))] * bool(before) + [F.when((F.col("i") % own < after) & (chunk > 0), place(chunk - 1, False))] * bool(after)
        where = F.array_compact(F.array(place(chunk, True), *also))
        dealt = rows.select(*self.keys, "i", "v", "row", F.explode(where).alias("w")).select(*self.keys, "w.chunk", "i", "v", "w.mine", F.when(F.col("w.mine"), F.col("row")).alias("row"))
        packed = dealt.groupBy(*self.keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "v", "mine", "row"))).alias("items"))
        mine = F.filter("items", lambda x: x["mine"])
        # The last chunk's halo alone is no chunk: it has no rows of its own.
        self.packed = stored(
            packed.select(*self.keys, "chunk", F.flatten(F.transform("items", lambda x: x["v"])).alias("data"), F.size(F.filter("items", lambda x: ~x["mine"] & (x["i"] < F.col("chunk") * own))).alias("skip"), F.transform(mine, lambda x: x["row"]).alias("rows")).filter(F.size("rows") > 0), "halo"
        )

    def sums(self, local: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
        """(keys as key_0, ..., sums): the elementwise sum over a key's chunks of local(matrix with the halo, rows of halo)."""
        width = self.width

        def run(data: pd.Series, skip: pd.Series) -> pd.Series:
            return pd.Series([np.ravel(local(np.asarray(d).reshape(-1, width), int(s))).tolist() for d, s in zip(data, skip)], dtype=object)

        parts = self.packed.select(*self.keys, F.posexplode(F.pandas_udf(run, "array<double>")("data", "skip")).alias("place", "v"))
        added = parts.groupBy(*self.keys, "place").agg(F.sum("v").alias("v"))
        return added.groupBy(*self.keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("sums"))

    def rows_with(self, local: Callable[..., dict[str, np.ndarray]], added: dict[str, str], params: DataFrame | None = None) -> DataFrame:
        """The rows of df with the columns of `added` (name: type, in place of columns of these names) from local(matrix, rows of halo[, params of the key]) -> {name: a value an own row}. params: key_0, ..., p (array<double>)."""
        width = self.width
        kind = ", ".join(f"`{n}` array<{t}>" for n, t in added.items())

        def results(data: pa.Array, skip: pa.Array, *own: pa.Array) -> pa.Array:
            return joined([local(d.reshape(-1, width), s, *rest) for d, s, *rest in zip(cut(data), skip.to_pylist(), *map(cut, own))], added)

        def run(data: pa.Array, skip: pa.Array) -> pa.Array:
            return results(data, skip)

        def run_with(data: pa.Array, skip: pa.Array, p: pa.Array) -> pa.Array:
            return results(data, skip, p)

        rows = self.packed
        if params is not None:
            params = params.select(*[F.col(k).alias(f"own_{k}") for k in self.keys], "p")
            rows = rows.join(params, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in self.keys])
        new = F.arrow_udf(run, f"struct<{kind}>")("data", "skip") if params is None else F.arrow_udf(run_with, f"struct<{kind}>")("data", "skip", "p")
        one = rows.select("rows", new.alias("new")).select("rows", *[F.col(f"new.{n}").alias(f"new_{i}") for i, n in enumerate(added)]).select(F.explode(F.arrays_zip("rows", *[f"new_{i}" for i in range(len(added))])).alias("one"))
        return one.select(*[F.col(f"one.rows.`{c}`") for c in self.columns if c not in added], *[F.col(f"one.new_{i}").alias(n) for i, n in enumerate(added)])


def window_sums(x: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """Sums over x[j - rows : j] for each j of `at`."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return total[at] - total[at - rows]


def places(n: int, skip: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(own rows with a full window before them, where those lie in a matrix of n rows with `skip` rows of halo)."""
    own = np.flatnonzero(np.arange(skip, n) >= rows)
    return own, own + skip


def rolling_factors(df: DataFrame, vector: str, width: int, keys, order, rows: int = 200, count: int = 8, own: int | None = None) -> DataFrame:
    """Adds factors: the `count` leading principal components of the `rows` rows before a row, standardised by their own mean and deviation, at the last of these rows; all 0 before there are as many.

    The signs are such that the loading of greatest size is positive. A column that is constant in a window counts as 0. Where two
    components have equal variances their directions are not determined. The windows' products are running sums, each row
    adding its own and taking out that of the row that leaves, and are decomposed together.
    """

    def local(data, skip):
        out = np.zeros((len(data) - skip, count))
        mine, at = places(len(data), skip, rows)
        x = data - data.mean(0)
        x = x / np.where((s := x.std(0)) > 0, s, 1.0)
        for begin in range(0, len(mine), 512):
            j = at[begin : begin + 512]
            part = x[j[0] - rows : j[-1]]
            near = j - (j[0] - rows)
            mean = window_sums(part, near, rows) / rows
            cov = window_sums(part[:, :, None] * part[:, None, :], near, rows) / rows - mean[:, :, None] * mean[:, None, :]
            var = np.diagonal(cov, axis1=1, axis2=2)
            sd = np.where(var > 1e-12, np.sqrt(np.maximum(var, 0)), np.inf)
            axes = np.linalg.eigh(cov / sd[:, :, None] / sd[:, None, :])[1][:, :, ::-1][:, :, :count]
            top = np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None, :], axis=1)
            axes = axes * np.where(top < 0, -1.0, 1.0)
            out[mine[begin : begin + 512], : axes.shape[2]] = np.einsum("ti,tik->tk", (x[j - 1] - mean) / sd, axes)
        return {"factors": out}

    return Halo(df, F.col(vector), width, keys, order, rows, own).rows_with(local, {"factors": "array<double>"})


def shrunk(cov, mean, squares, thirds, fourths, rows):
    """Covariances (dividing by rows) shrunk towards a multiple of the identity by the intensity of Ledoit and Wolf, from window means of x, |x|^2, |x|^2 x and |x|^4."""
    p = cov.shape[-1]
    trace = np.trace(cov, axis1=1, axis2=2)
    mm = (mean * mean).sum(1)
    # The mean of |x - m|^4, multiplied out.
    second = cov + mean[:, :, None] * mean[:, None, :]
    quad = np.einsum("ti,tij,tj->t", mean, second, mean)
    fourth = fourths + 4 * quad + mm * mm - 4 * (thirds * mean).sum(1) + 2 * squares * mm - 4 * mm * mm
    size = (cov * cov).sum((1, 2))
    delta = (size - trace * trace / p) / p
    beta = np.minimum((fourth - size) / (p * rows), delta)
    share = np.where((beta > 0) & (delta > 0), beta / np.where(delta > 0, delta, 1.0), 0.0)
    return (1 - share)[:, None, None] * cov + (share * trace / p)[:, None, None] * np.eye(p)


def rolling_precision(df: DataFrame, vector: str, width: int, keys, order, rows: int = 1800, ridge: float = 1e-3, shrink: bool = True, own: int | None = None) -> DataFrame:
    """Adds strength: for each of the `width` series of `vector`, the sum of the sizes of its off-diagonal entries in the inverse covariance of the `rows` rows before a row; null before there are as many.

    With shrink, the covariance is that of Ledoit and Wolf, `ridge` added to its diagonal; without it the sample covariance with twice `ridge`.
    The rolling means of products up to the fourth order give both, and all inverses are taken together. Rows with a missing value
    should be left out before.
    """

    def local(data, skip):
        out = np.full((len(data) - skip, width), np.nan)
        mine, at = places(len(data), skip, rows)
        centre = data.mean(0)
        x = data - centre
        q = (x * x).sum(1)
        for begin in range(0, len(mine), 512):
            j = at[begin : begin + 512]
            part, pq, near = x[j[0] - rows : j[-1]], q[j[0] - rows : j[-1]], j - (j[0] - rows)
            mean = window_sums(part, near, rows) / rows
            cov = window_sums(part[:, :, None] * part[:, None, :], near, rows) / rows - mean[:, :, None] * mean[:, None, :]
            if shrink:
                cov = shrunk(cov, mean, window_sums(pq, near, rows) / rows, window_sums(pq[:, None] * part, near, rows) / rows, window_sums(pq * pq, near, rows) / rows, rows) + ridge * np.eye(width)
            else:
                cov = cov * (rows / (rows - 1)) + 2 * ridge * np.eye(width)
            # A covariance with a positive diagonal added has a Cholesky factor, and its inverse is the product of the factor's.
            root = np.linalg.inv(np.linalg.cholesky(cov))
            inverse = np.abs(np.swapaxes(root, 1, 2) @ root)
            out[mine[begin : begin + 512]] = inverse.sum(2) - np.diagonal(inverse, axis1=1, axis2=2)
        return {"strength": out}

    found = Halo(df, F.col(vector), width, keys, order, rows, own).rows_with(local, {"strength": "array<double>"})
    return found.withColumn("strength", F.when(F.get("strength", F.lit(0)).isNotNull(), F.col("strength")))


def self_excitation(df: DataFrame, event: str, keys, order, lags: int = 60, ridge: float = 1e-3, fit_until: Column | None = None, own: int | None = None) -> DataFrame:
    """Adds intensity and slope (its change from the row before, 0 at first): a base rate plus `lags` weighted past events, at least 1e-6, by ridge least squares per key.

    Rows where fit_until does not hold are told by the weights of those where it does, which must come first; by default all are
    fitted on, which looks ahead. The first `lags` rows have the base rate. A key of no more than `lags` + 1 rows has the mean of its
    events. Null events count 0. The normal equations are sums of products of lags over the chunks of a series, so what
    is solved is one small system a key.
    """
    numbers = F.array(F.coalesce(F.col(event), F.lit(0)).cast("double"), (F.lit(1.0) if fit_until is None else F.coalesce(fit_until, F.lit(False)).cast("double")))
    halo = Halo(df, numbers, 2, keys, order, lags + 1, own)
    past = lambda e: np.lib.stride_tricks.sliding_window_view(e, lags)[:-1, ::-1]  # noqa: E731  row t of it: the events before row t + lags

    def products(data, skip):
        e, fits = data[:, 0], data[:, 1] == 1
        n, first = int(fits[skip:].sum()), max(lags, skip)
        total = np.array([n, e[skip:][fits[skip:]].sum()])
        if len(e) <= first:
            return np.concatenate([total, np.zeros(lags * lags + 2 * lags + 2)])
        x, use = past(e)[first - lags :], fits[first:]
        x, y = x[use], e[first:][use]
        return np.concatenate([total, np.ravel(x.T @ x), x.T @ y, x.sum(0), [y.sum(), len(y)]])

    def solve(sums: pd.Series) -> pd.Series:
        out = []
        for s in sums:
            s = np.asarray(s)
            n, events, rest = s[0], s[1], s[2:]
            if n <= lags + 1:
                out.append([0.0, events / n if n else 0.0])
                continue
            xx, xy, x, (y, m) = rest[: lags * lags].reshape(lags, lags), rest[lags * lags : lags * lags + lags], rest[lags * lags + lags : -2], rest[-2:]
            a = np.linalg.solve(xx + ridge * np.eye(lags), xy)
            out.append([1.0, max(1e-6, (y - x @ a) / m), *a.tolist()])
        return pd.Series(out, dtype=object)

    def rates(data, skip, p):
        e = data[:, 0]
        rate = np.full(len(e), p[1])
        if p[0] and len(e) > lags:
            rate[lags:] = np.maximum(p[1] + past(e) @ p[2:], 1e-6)
        if skip:  # the halo's first rows have no rows before them here, but the last of them does
            change = np.diff(rate[skip - 1 :])
        else:
            change = np.diff(rate, prepend=rate[:1])
        return {"intensity": rate[skip:], "slope": change}

    fitted = halo.sums(products)
    params = fitted.select(*halo.keys, F.pandas_udf(solve, "array<double>")("sums").alias("p"))
    return halo.rows_with(rates, {"intensity": "double", "slope": "double"}, params)

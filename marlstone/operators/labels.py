"""Labels, noise-robust variance and samples for a model of returns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import log, quotient, ratio
from marlstone.operators.halo import OWN, Halo
from marlstone.operators.joins import hops


#: Below the sort key of every number.
LOWEST = np.iinfo(np.int64).min


def sort_keys(v: np.ndarray) -> np.ndarray:
    """Integers in the order of v as SQL has it: NaN equals itself and is above all others, minus 0 equals 0. Their negatives have the opposite order."""
    bits = (v + 0.0).view(np.int64)
    return np.where(np.isnan(v), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))


def highest(v: np.ndarray, span: int) -> list[np.ndarray]:
    """At level k the greatest of the 2^k sort keys from each place on, what lies beyond the end counting as the lowest; levels up to `span` keys."""
    levels = [v]
    while len(levels) < span.bit_length():
        step = 1 << (len(levels) - 1)
        levels.append(np.maximum(levels[-1], np.concatenate([levels[-1][step:], np.full(min(step, len(v)), LOWEST)])))
    return levels


def first_reach(levels: list[np.ndarray], start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each start the first place from it on whose value is the bound or more, the length if there is none within the levels' span. Runs that stay below are leapt over, the longest first."""
    n, at = len(levels[0]), start.copy()
    for k in range(len(levels) - 1, -1, -1):
        low = at < n
        low[low] = levels[k][at[low]] < bound[low]
        at = np.where(low, at + (1 << k), at)
    return np.minimum(at, n)


def triple_barrier(df: DataFrame, value: str, sigma: str, keys, order, up: float = 2.0, down: float = 1.5, horizon: int = 2700, own: int | None = None, zeros: bool = False) -> DataFrame:
    """Adds label, t_hit and ret: which of value * (1 + up * sigma) and value * (1 - down * sigma) the next `horizon` rows touch first.

    sigma is the last one known. label: 1 above, -1 below, 0 for neither; a row that touches both counts as above if it
    is the next one, as below otherwise. t_hit: the row (from 0) of the touch, or the last row looked at; ret: the
    return up to it, null from 0 (with `zeros` an infinity, from 0 to 0 NaN). A key's last row has neither. NaN is missing as null is, and infinite
    barriers are never touched; with `zeros` only null is missing, and NaN is above all numbers. Chunks of `own` rows carry the `horizon` rows behind them, and an index of
    maxima over powers of two finds a touch in as many steps as the horizon has bits.
    """

    size = own or max(OWN, 4 * horizon)

    def local(data, skip):
        number, v, s, *gaps = data.T
        n, mine = len(data), np.flatnonzero(np.floor(number / size) == np.floor(number[skip] / size))
        price, width = v[mine], s[mine]
        last = np.minimum(mine + horizon, n - 1)
        void, unknown = [g == 1 for g in gaps] if zeros else [np.isnan(v), np.isnan(s)]
        told = ~(void | unknown)[mine]

        def touch(way, share):
            with np.errstate(over="ignore", invalid="ignore"):
                bound = price * (1 + share * width)
            at = first_reach(highest(np.where(void, LOWEST, way * sort_keys(v)), horizon), mine + 1, way * sort_keys(bound))
            return np.where((at <= last) & (told if zeros else told & np.isfinite(bound)), at, n)

        a, b = touch(1, up), touch(-1, -down)
        above = (a < n) & ((a < b) | (a == b) & (a == mine + 1))
        label = np.where(above, 1, np.where(b < n, -1, 0))
        hit = np.where(above, a, np.where(b < n, b, last))
        # A NaN that is no gap is told apart from null, as which it would be handed on.
        return {"label": label, "t_hit": np.where(hit > mine, number[hit], np.nan), "ret": np.where(hit > mine, v[hit], np.nan)} | ({"_nan": (hit > mine) & np.isnan(v[hit]) & ~void[hit]} if zeros else {})

    w = Window.partitionBy(*keys).orderBy(*order)
    known = df.withColumn("_sigma", F.last(sigma, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbers = [F.col(value), F.col("_sigma"), *([F.col(c).isNull().cast("double") for c in (value, "_sigma")] if zeros else [])]
    halo = Halo(known, F.array(*numbers), len(numbers), keys, order, 0, size, after=horizon, numbered=True)
    found = halo.rows_with(local, {"label": "int", "t_hit": "double", "ret": "double"} | ({"_nan": "int"} if zeros else {}))
    if zeros:
        found = found.withColumn("ret", F.when(F.col("_nan") == 1, float("nan")).otherwise(F.col("ret")))
    return found.withColumns({"t_hit": F.col("t_hit").cast("int"), "ret": (quotient if zeros else ratio)(F.col("ret"), F.col(value)) - 1}).drop("_sigma", "_nan")


def pre_averaged_variance(df: DataFrame, value: str, keys, order, span: int = 30, rows: int = 1800, zeros: bool = False) -> DataFrame:
    """Adds pav_rv: the mean square of pre-averaged log returns of blocks of `span` rows within the last `rows`, the last one known.

    A block's return weighs its `span` - 1 steps by k / span - 1/2. Blocks end `span`, 2 * `span`, ... rows before the own
    one, the newest left out; so a mean is taken over rows of one remainder of the row number, by one window. With `zeros` the log of 0 is minus infinity, of less NaN.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    logs = df.withColumns({"row_at": F.row_number().over(w) - 1, "log_value": log(F.col(value), zeros)})
    logs = logs.withColumn("step", F.col("log_value") - F.lag("log_value").over(w))
    # Step by step: a step of infinite size must meet its own weight, which differences of sums lose.
    block = sum(F.lit(k / span - 0.5) * F.lag("step", span - 1 - k).over(w) for k in range(1, span))
    logs = logs.withColumn("block", block).withColumn("block_square", F.col("block") * F.col("block")).drop("block")
    blocks = rows // span - 1
    same = Window.partitionBy(*keys, F.pmod("row_at", F.lit(span))).orderBy(*order).rowsBetween(-blocks, -1)
    mean = F.when((F.col("row_at") >= rows) & (F.count("block_square").over(same) == blocks), F.avg("block_square").over(same))
    logs = logs.withColumn("pav_rv", mean)
    return logs.withColumn("pav_rv", F.last("pav_rv", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("row_at", "log_value", "step", "block_square")


def bar_seconds(rule: str) -> int:
    """Seconds of a bar rule such as 10S, 1min, 2h or 1D; 60 for what is none."""
    digits = rule[: len(rule) - len(rule.lstrip("0123456789"))]
    units = {"s": 1, "sec": 1, "t": 60, "min": 60, "h": 3600, "d": 86400}
    size = units.get(rule[len(digits) :].lower())
    return int(digits or 1) * size if size else 60


def split_by_time(df: DataFrame, keys, order, share: float = 0.7) -> DataFrame:
    """Adds role: train for the first floor(share * n) rows of a key, test for the others."""
    w = Window.partitionBy(*keys)
    return df.withColumn("role", F.when(F.row_number().over(w.orderBy(*order)) <= F.floor(share * F.count("*").over(w)), "train").otherwise("test"))


def category_codes(df: DataFrame, value: str, into: str = "code") -> DataFrame:
    """Adds `into`: the place of the value among the distinct ones, from 0; -1 for null. The distinct values, not the rows, are ranked, and joined back."""
    codes = df.select(F.col(value).alias("category")).distinct().filter("category IS NOT NULL").withColumn(into, (F.row_number().over(Window.orderBy("category")) - 1).cast("int"))
    return df.join(codes, F.col(value) == F.col("category"), "left").drop("category").withColumn(into, F.coalesce(into, F.lit(-1)))


def sample_scores(df: DataFrame, value: str, by, floor: float = 1e-6) -> DataFrame:
    """Adds z: the value less its sample's mean, over its sample deviation, at least `floor`."""
    w = Window.partitionBy(*by)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.greatest(F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(floor)))


def strided_windows(df: DataFrame, value: str, keys, order, rows: int, stride: int, horizon: int = 0, scale: float | None = None) -> DataFrame:
    """Per key, a row each `stride` rows from the first on that has `rows` rows, and `horizon` after them: keys, begin (from 0), x and y, the values of both. scale: divided by it and held in -1..1."""
    v = F.col(value) if scale is None else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(value) / scale))
    marked = df.select(*keys, v.alias("v"), (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias("i"))
    # A row goes to the few windows that hold it; no other window is gathered.
    inside = hops(marked, "i", F.lit(0), rows + horizon - 1, stride)
    whole = inside.groupBy(*keys, "hop").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("all")).filter(F.col("n") == rows + horizon)
    return whole.select(*keys, (F.col("hop") * stride).cast("int").alias("begin"), F.slice("all", 1, rows).alias("x"), F.slice("all", rows + 1, horizon).alias("y"))


def type_masks(types: DataFrame, kind: str = "type", kinds: int = 4) -> DataFrame:
    """Adds mask: one for the feature's own kind, zero for the others."""
    return types.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(kinds - 1)), lambda k: (F.col(kind) == k).cast("int")))


def top_per_row(values: Column, k: int) -> Column:
    """The k greatest elements of an array, falling."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def batches(df: DataFrame, keys, order, size: int) -> DataFrame:
    """Adds batch: rows of a key in groups of `size`, the last one as long as what is left."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))

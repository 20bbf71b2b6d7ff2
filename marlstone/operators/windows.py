"""Window transforms of keyed, ordered series: lags, fills, moments, indicators, runs.

Keys name the series and `order` ends in a unique column. Null values are missing; frames count rows, not time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import log, ratio, sample_skewness
from marlstone.operators.series import at_least, trailing


def ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def running(keys, order):
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def returns(df: DataFrame, value: str, keys, order, lag: int = 1, zeros: bool = False) -> DataFrame:
    """Adds diff, pct (null after a zero) and logret (null unless both values are positive) over `lag` rows. With `zeros` the log of 0 is minus infinity, of less NaN."""
    c, before = F.col(value), F.lag(value, lag).over(ordered(keys, order))
    return df.withColumns({"diff": c - before, "pct": ratio(c, before) - 1, "logret": log(c, zeros) - log(before, zeros)})


def fills(df: DataFrame, value: str, keys, order) -> DataFrame:
    """Adds ffill and bfill: the last value known at a row and the next one."""
    back = ordered(keys, order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({"ffill": F.last(value, ignorenulls=True).over(running(keys, order)), "bfill": F.first(value, ignorenulls=True).over(back)})


def rolling_skew(df: DataFrame, value: str, keys, order, rows: int) -> DataFrame:
    """Adds skew, bias-adjusted, over a full window; null for a constant one."""
    w = trailing(keys, order, rows)
    skew = sample_skewness(F.skewness(value).over(w), F.count(value).over(w))
    return df.withColumn("skew", F.when((F.count(value).over(w) == rows) & (F.var_pop(value).over(w) > 1e-12), skew))


def rolling_slope(df: DataFrame, value: str, keys, order, rows: int) -> DataFrame:
    """Adds slope: least squares of the window's values on their positions; null unless all are there."""
    df = df.withColumn("_i", F.row_number().over(ordered(keys, order)).cast("double"))
    w, centre = trailing(keys, order, rows), F.col("_i") - (rows - 1) / 2
    sxy = F.sum(F.col("_i") * F.col(value)).over(w) - centre * F.sum(value).over(w)
    return df.withColumn("slope", at_least(rows, value, w, sxy / (rows * (rows * rows - 1) / 12))).drop("_i")


def lag_features(df: DataFrame, ret: str, volume: str, keys, order, lags: int = 5) -> DataFrame:
    """Adds what is known before a row of returns and volumes: ret_lag1.., vol_5, vol_10, mom_3, mom_6, vol_log, vol_chg, vol_ratio, skew_10."""
    w = ordered(keys, order)
    past = lambda n: w.rowsBetween(-n, -1)
    full = lambda c, n, result: F.when(F.count(c).over(past(n)) == n, result)
    df = df.withColumn("_v", F.when(F.col(volume) >= 0, F.ln(F.col(volume) + 1e-9)))
    out = {f"ret_lag{i}": F.lag(ret, i).over(w) for i in range(1, lags + 1)}
    out |= {f"vol_{n}": full(ret, n, F.stddev_samp(ret).over(past(n))) for n in (5, 10)}
    out |= {f"mom_{n}": full(ret, n, F.sum(ret).over(past(n))) for n in (3, 6)}
    v1 = F.lag("_v", 1).over(w)
    out |= {"vol_log": v1, "vol_chg": v1 - F.lag("_v", 2).over(w), "vol_ratio": v1 - full("_v", 10, F.avg("_v").over(past(10)))}
    out["skew_10"] = full(ret, 10, F.when(F.var_pop(ret).over(past(10)) > 1e-12, sample_skewness(F.skewness(ret).over(past(10)), F.count(ret).over(past(10)))))
    return df.withColumns(out).drop("_v")


def bands(df: DataFrame, value: str, keys, order, rows: int = 20, width: float = 2.0) -> DataFrame:
    """Adds bb_middle, bb_upper, bb_lower: the mean and `width` sample deviations on either side, over a full window."""
    w = trailing(keys, order, rows)
    mid, sd = at_least(rows, value, w, F.avg(value).over(w)), F.stddev_samp(value).over(w)
    return df.withColumns({"bb_middle": mid, "bb_upper": mid + width * sd, "bb_lower": mid - width * sd})


def decayed_mean(value: str, keys, order, alpha: float, tolerance: float = 1e-12) -> Column:
    """The exponential mean e' = (1 - alpha) e + alpha x from the first value on.

    A fold over the rows whose weight exceeds `tolerance`: a bounded frame, so that no row depends on the whole series.
    The frame's first value takes the weight of what lies before it. Nulls are left out.
    """
    rows = math.ceil(math.log(tolerance) / math.log(1 - alpha))
    seen = F.collect_list(value).over(trailing(keys, order, rows))
    return F.when(F.size(seen) > 0, F.aggregate(F.slice(seen, F.lit(2), F.greatest(F.size(seen) - 1, F.lit(0))), F.try_element_at(seen, F.lit(1)), lambda e, x: (1 - alpha) * e + alpha * x))


def convergence(df: DataFrame, value: str, keys, order, fast=12, slow=26, signal=9, tolerance: float = 1e-12) -> DataFrame:
    """Adds macd (fast less slow exponential mean), macd_signal (its own exponential mean) and macd_hist."""
    mean = lambda c, span: decayed_mean(c, keys, order, 2 / (span + 1), tolerance)
    df = df.withColumn("macd", mean(value, fast) - mean(value, slow))
    df = df.withColumn("macd_signal", mean("macd", signal))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def drawdown(df: DataFrame, ret: str, keys, order) -> DataFrame:
    """Adds cumulative (compounded return, for returns above -1), peak (its maximum so far, at least its first value) and drawdown (their difference)."""
    w = running(keys, order)
    df = df.withColumn("cumulative", F.exp(F.sum(F.log1p(ret)).over(w)) - 1)
    df = df.withColumn("peak", F.max("cumulative").over(w))
    return df.withColumn("drawdown", F.col("cumulative") - F.col("peak"))


def runs(df: DataFrame, value: str, keys, order) -> DataFrame:
    """One row per run of equal values in a series: keys, run, value, first, last (the first order column), n. Null is a value of its own."""
    w = ordered(keys, order)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(running(keys, order)))
    return numbered.groupBy(*keys, "run").agg(F.min_by(value, F.struct(*order)).alias("value"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def lag_vectors(df: DataFrame, value: str, keys, order, size: int, ahead: int = 1) -> DataFrame:
    """Adds x, the array of the `size` values before a row, and y, the sum of `ahead` values from the row on; rows without full frames go."""
    w = ordered(keys, order)
    past, future = w.rowsBetween(-size, -1), w.rowsBetween(0, ahead - 1)
    df = df.withColumns({"x": F.collect_list(value).over(past), "_n": F.count(value).over(future), "y": F.sum(value).over(future)})
    return df.filter((F.size("x") == size) & (F.col("_n") == ahead)).drop("_n")


def standardized(df: DataFrame, value: str, keys) -> DataFrame:
    """Adds z (population deviation; null for a constant key) and unit (0 at the key's minimum, 1 at its maximum). The moments are aggregated before they are joined."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    c = F.col(value)
    return df.join(stats, list(keys)).withColumns({"z": F.when(F.col("_s") > 1e-12, (c - F.col("_m")) / F.col("_s")), "unit": ratio(c - F.col("_lo"), F.col("_hi") - F.col("_lo"))}).drop("_m", "_s", "_lo", "_hi")


def unscaled(df: DataFrame, value: str, unit: str, keys) -> DataFrame:
    """Adds restored: the inverse of `unit` as standardized() gives it, from the key's minimum and maximum of `value`."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("least_value"), F.max(value).alias("greatest_value"))
    return df.join(stats, list(keys)).withColumn("restored", F.col("least_value") + F.col(unit) * (F.col("greatest_value") - F.col("least_value"))).drop("least_value", "greatest_value")


def exceedances(df: DataFrame, value: str, scale: str, theta: float) -> DataFrame:
    """Adds event: 1 where |value| is above theta * scale, else 0; a zero or missing scale gives 0."""
    return df.withColumn("event", F.coalesce(F.abs(F.col(value)) > theta * F.nullif(F.col(scale), F.lit(0.0)), F.lit(False)).cast("int"))


def extrema(df: DataFrame, value: str, keys, order) -> DataFrame:
    """Adds extremum: 1 at a peak, -1 at a trough, else 0, by the signs of the differences on either side."""
    w = ordered(keys, order)
    before, after = F.signum(F.col(value) - F.lag(value).over(w)), F.signum(F.lead(value).over(w) - F.col(value))
    return df.withColumn("extremum", F.when(after - before < 0, 1).when(after - before > 0, -1).otherwise(0))


def hurst(df: DataFrame, value: str, keys, order, rows: int, scales=(1, 2, 4, 8, 16)) -> DataFrame:
    """Adds hurst: half the slope of the log variance of h-row log differences on log h, over the trailing window; null until it is full or if a variance is 0."""
    w = ordered(keys, order)
    df = df.withColumns({"_p": F.when(F.col(value) > 0, F.ln(value))}).withColumns({f"_d{h}": F.col("_p") - F.lag("_p", h).over(w) for h in scales})
    x = [math.log(h) for h in scales]
    mx = sum(x) / len(x)
    sxx = sum((v - mx) ** 2 for v in x)
    var = {h: F.var_pop(f"_d{h}").over(w.rowsBetween(-(rows - 1 - h), 0)) for h in scales}
    terms = [F.lit((v - mx) / sxx) * F.ln(F.when(var[h] > 1e-15, var[h])) for v, h in zip(x, scales)]
    return df.withColumn("hurst", at_least(rows, "_p", trailing(keys, order, rows), sum(terms[1:], terms[0]) / 2)).drop("_p", *[f"_d{h}" for h in scales])


def drift_burst(df: DataFrame, value: str, keys, order, blocks: int, rows: int, zeros: bool = False) -> DataFrame:
    """Adds burst: mean over sd (population) of the mean steps in `blocks` blocks of `rows` rows of the detrended log value, held in +-5; 0 until the window is full. With `zeros` the log of 0 is minus infinity, of less NaN, and bursts over them are NaN, held at 5."""
    w, size = ordered(keys, order), blocks * rows
    df = df.withColumn("_i", F.row_number().over(w).cast("double")).withColumn("_p", log(F.col(value), zeros))
    frame = trailing(keys, order, size)
    beta = (F.sum(F.col("_i") * F.col("_p")).over(frame) - (F.col("_i") - (size - 1) / 2) * F.sum("_p").over(frame)) / (size * (size * size - 1) / 12)
    at = lambda back: F.lag("_p", back).over(w) if back else F.col("_p")
    steps = F.array(*[(at(size - 1 - (j + 1) * rows + 1) - at(size - 1 - j * rows)) / (rows - 1) for j in range(blocks)])
    df = df.withColumns({"_beta": beta, "_steps": steps, "_n": F.count("_p").over(frame)})
    df = df.withColumn("_steps", F.transform("_steps", lambda s: s - F.col("_beta")))
    mean = F.aggregate("_steps", F.lit(0.0), lambda a, s: a + s) / blocks
    df = df.withColumn("_mean", mean)
    sd = F.sqrt(F.aggregate("_steps", F.lit(0.0), lambda a, s: a + (s - F.col("_mean")) * (s - F.col("_mean"))) / blocks) + 1e-8
    return df.withColumn("burst", F.when(F.col("_n") == size, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("_mean") / sd))).otherwise(0.0)).drop("_i", "_p", "_beta", "_steps", "_n", "_mean")


def signature(df: DataFrame, value: str, keys, order, rows: int, zeros: bool = False) -> DataFrame:
    """Adds s1_* and s2_*_*: the sums of the steps, and of their products, of the path (time, log value, both one row before) over the trailing window. With `zeros` the log of 0 is minus infinity, of less NaN."""
    w = ordered(keys, order)
    df = df.withColumn("_p", log(F.col(value), zeros)).withColumn("_x1", F.col("_p") - F.lag("_p").over(w))
    df = df.withColumns({"_x0": F.when(F.col("_x1").isNotNull(), F.lit(1.0 / (rows - 1))), "_x3": F.lag("_x1").over(w)}).withColumn("_x2", F.lag("_x0").over(w))
    frame = trailing(keys, order, rows - 1)
    full = lambda result: F.when(F.count("_x3").over(frame) == rows - 1, result)
    out = {f"s1_{i}": full(F.sum(f"_x{i}").over(frame)) for i in range(4)}
    out |= {f"s2_{i}_{j}": full(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).over(frame)) for i in range(4) for j in range(4)}
    return df.withColumns(out).drop("_p", *[f"_x{i}" for i in range(4)])

"""Strategies, their measures, folds for validation, position sizes and checks of typed features."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import correlation


def capped_strategy(df: DataFrame, score: str, ret: str, keys, order, threshold: float = 5.0, hold: int = 60, most: int = 5) -> DataFrame:
    """Adds opened and pnl: a score beyond +-threshold opens a position of its sign, held `hold` rows, its own row's return included, with at most `most` open at once.

    Whether a row may open depends on those before it: the rows beyond the threshold are visited in order, a key in one
    task; what is held is a running sum of openings less endings. A null score opens nothing; a null return counts as 0.
    """
    schema = df.select("*", F.lit(False).alias("opened"), F.lit(0.0).alias("pnl")).schema

    def fold(pdf):
        pdf = pdf.sort_values(list(order), kind="stable")
        n, scores = len(pdf), pdf[score].to_numpy(float)
        opened, net, ends = np.zeros(n, bool), np.zeros(n + 1), deque(maxlen=most)
        # All positions last equally long, so they end in the order in which they begin: a place is free if the oldest of the last `most` has ended.
        for i in np.flatnonzero(np.abs(scores) > threshold).tolist():
            if len(ends) < most or ends[0] <= i:
                end = min(i + hold, n - 1)
                ends.append(end)
                opened[i] = True
                net[i] += np.sign(scores[i])
                net[max(end, i + 1)] -= np.sign(scores[i])
        return pdf.assign(opened=opened, pnl=np.cumsum(net[:n]) * pdf[ret].fillna(0.0).to_numpy())

    return df.groupBy(*keys).applyInPandas(fold, schema)


def open_strategy(df: DataFrame, score: str, ret: str, keys, order, threshold: float = 5.0, hold: int = 60) -> DataFrame:
    """As capped_strategy without a cap, by windows alone: the pnl is the sum of the signs opened in the last `hold` rows times the return."""
    w = Window.partitionBy(*keys).orderBy(*order)
    way = F.when(F.col(score) > threshold, 1).when(F.col(score) < -threshold, -1).otherwise(0)
    df = df.withColumn("_way", way)
    held = F.sum("_way").over(w.rowsBetween(1 - hold, 0))
    return df.withColumns({"opened": F.col("_way") != 0, "pnl": held * F.coalesce(F.col(ret), F.lit(0.0))}).drop("_way")


def performance(df: DataFrame, ret: str, opened: str, keys, order, day, fee: float = 0.0005) -> DataFrame:
    """Per key: trades, fees, hit_rate, avg_per_trade, cumulative, max_drawdown, and from calendar days' sums, 0 on empty days, daily_sd, sharpe and sortino, times the root of 252."""
    from marlstone.operators.joins import daily_sums
    from marlstone.operators.windows import drawdown

    net = drawdown(df.withColumn("_net", F.col(ret) - F.when(F.col(opened), fee).otherwise(0.0)), "_net", keys, order)
    whole = net.groupBy(*keys).agg(
        F.count_if(F.col(opened)).alias("trades"), (fee * F.count_if(F.col(opened))).alias("fees"),
        F.try_divide(F.count_if(F.col("_net") > 0), F.count_if(F.col("_net") != 0)).alias("hit_rate"), F.avg(F.when(F.col(opened), F.col("_net"))).alias("avg_per_trade"),
        F.max_by("cumulative", F.struct(*order)).alias("cumulative"), F.min("drawdown").alias("max_drawdown"),
    )
    days = daily_sums(net, keys, day, "_net").groupBy(*keys).agg(F.avg("total").alias("_m"), F.stddev_samp("total").alias("daily_sd"), F.stddev_samp(F.when(F.col("total") < 0, F.col("total"))).alias("_down"))
    year = F.sqrt(F.lit(252.0))
    over = lambda sd: F.when(F.col(sd) > 1e-12, F.col("_m") / F.col(sd) * year)
    return whole.join(days.select(*keys, "daily_sd", over("daily_sd").alias("sharpe"), over("_down").alias("sortino")), list(keys))


def forecast_strategy(df: DataFrame, guess: str, actual: str, by, periods: float = 252.0 * 39) -> DataFrame:
    """Per group: n, rmse, mae, corr and direction (share of equal signs) of the forecasts, and sharpe of holding their sign, times the root of `periods` a year; 0 for a constant result."""
    rows = df.filter(F.col(guess).isNotNull() & F.col(actual).isNotNull())
    gap, held = F.col(guess) - F.col(actual), F.signum(guess) * F.col(actual)
    sharpe = F.when(F.stddev_samp(held) > 1e-12, F.avg(held) / F.stddev_samp(held) * periods**0.5).otherwise(0.0)
    same = F.avg((F.signum(guess) == F.signum(actual)).cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), correlation(F.col(guess), F.col(actual)).alias("corr"), same.alias("direction"), sharpe.alias("sharpe"))


def position_sizes(df: DataFrame, score: str, risk: str, by, gross: float = 1.0, cap: float = 0.1) -> DataFrame:
    """Adds weight: score / risk held in +-cap, then scaled so that a group's absolute weights sum to `gross`; 0 where risk is missing or 0. The scaling may lift a weight over the cap."""
    raw = F.coalesce(F.try_divide(F.col(score), F.col(risk)), F.lit(0.0))
    held = df.withColumn("_raw", F.greatest(F.lit(-cap), F.least(F.lit(cap), raw)))
    sums = held.groupBy(*by).agg(F.sum(F.abs("_raw")).alias("_sum"))
    return held.join(sums, list(by)).withColumn("weight", F.when(F.col("_sum") > 0, gross * F.col("_raw") / F.col("_sum")).otherwise(0.0)).drop("_raw", "_sum")


def embargoed_folds(df: DataFrame, keys, order, folds: int = 3, embargo: int = 0, purge: int = 0) -> DataFrame:
    """One row per row and fold: fold, role. A series is cut into contiguous test folds, the first ones longer by a row if need be; `purge` rows before a test fold and `embargo` rows after it are in neither set."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    size, more = F.floor(F.col("_n") / folds), F.col("_n") % folds
    begin = F.col("fold") * size + F.least(F.col("fold"), more)
    end = begin + size + F.when(F.col("fold") < more, 1).otherwise(0)
    role = F.when((F.col("_i") >= begin) & (F.col("_i") < end), "test").when((F.col("_i") >= end) & (F.col("_i") < end + embargo), "embargo").when((F.col("_i") < begin) & (F.col("_i") >= begin - purge), "purged").otherwise("train")
    return df.withColumn("role", role).drop("_i", "_n")


def feature_types(df: DataFrame, value: str, by) -> DataFrame:
    """Per feature: type 0 for values in {0, 0.1}, 1 for {0, -0.1}, 2 for [0, 0.1], 3 for [-0.1, 0], to six places; a feature of both signs goes by the sign of its value farthest from 0, up on a tie."""
    v = F.round(F.col(value), 6)
    is_in = lambda x: F.coalesce(F.bool_and((v == 0) | (v == x)), F.lit(False))
    stats = df.groupBy(*by).agg(is_in(0.1).alias("a"), is_in(-0.1).alias("b"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return stats.select(*by, F.when(F.col("a"), 0).when(F.col("b"), 1).when(F.col("lo") >= 0, 2).when(F.col("hi") <= 0, 3).when(F.col("hi") >= -F.col("lo"), 2).otherwise(3).alias("type"))


def violations(df: DataFrame, value: str, kind: str, by) -> DataFrame:
    """Per feature: broken, the number of values outside their type's domain, and n."""
    v = F.round(F.col(value), 6)
    fits = F.when(F.col(kind) == 0, v.isin(0.0, 0.1)).when(F.col(kind) == 1, v.isin(0.0, -0.1)).when(F.col(kind) == 2, v.between(0.0, 0.1)).otherwise(v.between(-0.1, 0.0))
    return df.groupBy(*by).agg(F.count_if(~fits).alias("broken"), F.count(value).alias("n"))


def threshold_regression(df: DataFrame, y: str, x: str, z: str, keys, points: int = 100) -> DataFrame:
    """Per key: threshold, ssr and each side's intercept and slope: two lines, split at z <= threshold, of least squares in all; the least of `points` evenly spaced candidates from z's minimum to its maximum, the lowest one on ties.

    Rows are not joined with candidates. Each row falls into one interval between candidates; the intervals' moments
    are aggregated (at most `points` + 1 rows a key) and prefix sums over them give both sides of every split. Values
    are taken from the key's means first, so that the sums do not cancel.
    """
    named = {c: f"key_{i}" for i, c in enumerate(keys)}  # no name of the caller's meets one of ours
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*[F.col(c).alias(n) for c, n in named.items()], F.col(x).alias("x_in"), F.col(y).alias("y_in"), F.col(z).alias("z_in"))
    own, keys, (x, y, z) = list(keys), list(named.values()), ("x_in", "y_in", "z_in")
    span = rows.groupBy(*keys).agg(F.min(z).alias("_lo"), F.max(z).alias("_hi"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    at = F.coalesce(F.ceil(F.try_divide(F.col(z) - F.col("_lo"), step)), F.lit(0)).cast("int")
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    moments = {"n": F.lit(1.0), "x": dx, "y": dy, "xx": dx * dx, "xy": dx * dy, "yy": dy * dy}
    cells = rows.join(span, list(keys)).groupBy(*keys, F.least(at, F.lit(points - 1)).alias("k")).agg(*[F.sum(e).alias(n) for n, e in moments.items()], F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({f"l_{n}": F.sum(n).over(upto) for n in moments} | {f"t_{n}": F.sum(n).over(w) for n in moments}).withColumns({f"r_{n}": F.col(f"t_{n}") - F.col(f"l_{n}") for n in moments})

    def fit(s):
        n, sx, sy = F.col(f"{s}_n"), F.col(f"{s}_x"), F.col(f"{s}_y")
        sxx, sxy, syy = F.col(f"{s}_xx") - F.try_divide(sx * sx, n), F.col(f"{s}_xy") - F.try_divide(sx * sy, n), F.col(f"{s}_yy") - F.try_divide(sy * sy, n)
        slope = F.when(sxx > 1e-9, F.try_divide(sxy, sxx)).otherwise(0.0)
        icept = F.try_divide(sy, n) - slope * F.try_divide(sx, n) + F.col("_my") - slope * F.col("_mx")
        return slope, icept, F.when(n >= 2, syy - slope * sxy)

    (ls, li, le), (rs, ri, re) = fit("l"), fit("r")
    tried = cells.select(*keys, "k", (F.col("_lo") + F.col("k") * step).alias("threshold"), (le + re).alias("ssr"), li.alias("low_intercept"), ls.alias("low_slope"), ri.alias("high_intercept"), rs.alias("high_slope")).filter("ssr IS NOT NULL")
    best = tried.groupBy(*keys).agg(F.min(F.struct("ssr", "k", "threshold", "low_intercept", "low_slope", "high_intercept", "high_slope")).alias("b"))
    return best.select(*[F.col(n).alias(c) for c, n in zip(own, keys)], "b.threshold", "b.ssr", "b.low_intercept", "b.low_slope", "b.high_intercept", "b.high_slope")


def information(df: DataFrame, features, target: str, by=()) -> DataFrame:
    """Per feature (and group): n, ic, t, the rank correlation with the target, to four places, and its t statistic. Rows with a null in any feature go; below 30 rows there is no report."""
    from marlstone.operators.series import rank_correlation

    whole = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*features, target]))
    long = whole.select(*by, F.col(target).alias("_t"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("f")).select(*by, "_t", "f.feature", "f.v")
    found = rank_correlation(long, "v", "_t", [*by, "feature"]).filter("n >= 30")
    t = F.col("ic") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("ic") * F.col("ic")))
    return found.withColumn("t", t).withColumn("ic", F.round("ic", 4))


def correlations(df: DataFrame, columns) -> DataFrame:
    """One row per pair of columns a < b: corr over the rows where neither is null, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col(a), F.col(b)).alias("corr")) for a, b in pairs]).alias("p"))
    return row.select(F.explode("p").alias("p")).select("p.*")


def covariances(df: DataFrame, columns) -> DataFrame:
    """One row per pair of columns a <= b: cov, the sample covariance over the rows where neither is null, all in one aggregation; with a = b the variance."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("cov")) for a, b in pairs]).alias("p"))
    return row.select(F.explode("p").alias("p")).select("p.*")


def weighted_moments(df: DataFrame, value: str, weight: str, by) -> DataFrame:
    """Per group: weight (their sum), mean and sd (population) of the values under their weights; null where the weights add up to 0. Null values or weights count nothing."""
    rows = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    sums = rows.groupBy(*by).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("wvv"))
    mean = F.try_divide("wv", F.nullif("weight", F.lit(0.0)))
    return sums.select(*by, "weight", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("wvv", F.nullif("weight", F.lit(0.0))) - mean * mean, F.lit(0.0))).alias("sd"))

"""The research loop over book features: rolling moments at many scales, the whole feature matrix, and a set of informative features unlike each other."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import finite
from marlstone.operators import book as B
from marlstone.operators import decay as D
from marlstone.operators.halo import rolling_factors
from marlstone.operators.portfolio import correlations, information

# The scales of the pyramid and the features whose trend is taken.
WINDOWS = (5, 10, 30, 50, 100, 200, 500, 1000)
TRENDED = ("imbalance_L1", "imbalance_L5", "net_flow_signed", "toxicity", "mm_inventory_pressure", "book_divergence")


def rolling_pyramid(df: DataFrame, features: Sequence[str], keys, order, windows: Sequence[int] = WINDOWS, trended: Sequence[str] = TRENDED) -> DataFrame:
    """A row per row, feature and window: keys, order, feature, window, mean, sd (sample), skew (bias-adjusted) and, for trended features, slope.

    Moments need half a window of values (at least one), a slope all of them; a constant window has no skew. Long form: one
    sort by feature serves all windows. Moments of a window are differences of running sums of the values less the
    feature's mean, so a window costs the same at every length.
    """
    names = [F.struct(F.lit(c).alias("feature"), finite(F.col(c)).alias("x")) for c in features]
    long = df.select(*keys, *order, F.explode(F.array(*names)).alias("f")).select(*keys, *order, "f.*")
    whole = Window.partitionBy(*keys, "feature")
    w = whole.orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumns({"centre": F.avg("x").over(whole), "i": F.row_number().over(w).cast("double")})
    d = F.coalesce(F.col("x") - F.col("centre"), F.lit(0.0))
    terms = {"s0": F.col("x").isNotNull().cast("double"), "s1": d, "s2": d * d, "s3": d * d * d, "si": F.col("i") * d}
    long = long.withColumns({n: F.sum(e).over(upto) for n, e in terms.items()})
    found = []
    for size in windows:
        n, s1, s2, s3, si = (F.col(c) - F.coalesce(F.lag(c, size).over(w), F.lit(0.0)) for c in terms)
        m1 = F.try_divide(s1, n)
        m2 = F.try_divide(s2, n) - m1 * m1
        m3 = F.try_divide(s3, n) - 3 * m1 * F.try_divide(s2, n) + 2 * m1 * m1 * m1
        enough = n >= max(1, size // 2)
        squares = size * (size * size - 1) / 12
        found.append(F.struct(
            F.lit(size).alias("window"), F.when(enough, F.col("centre") + m1).alias("mean"), F.when(enough & (n > 1), F.sqrt(F.greatest(m2, F.lit(0.0)) * n / (n - 1))).alias("sd"),
            F.when(enough & (n >= 3) & (m2 > 1e-14), m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
            F.when(F.col("feature").isin(*trended) & (n == size), (si - (F.col("i") - (size - 1) / 2) * s1) / (squares + B.EPS)).alias("slope"),
        ))
    moments = long.select(*keys, *order, "feature", F.array(*found).alias("m"))
    return moments.select(*keys, *order, "feature", F.explode("m").alias("m")).select(*keys, *order, "feature", "m.*")


def surprise(df: DataFrame, keys, order, span: float = 50.0, quiet: int = 50) -> DataFrame:
    """keys, order and surprise_score: over the levels of both sides, the sum of (d - mean)^2 / (mean + EPS), d the size of a level's change of notional and mean its decayed mean over the snapshots so far; 0 on the first `quiet` ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("place", F.row_number().over(w) - 1)
    sides = [F.zip_with(f"{s}_notional", F.coalesce(F.lag(f"{s}_notional").over(w), F.col(f"{s}_notional")), lambda a, b: F.abs(a - b)) for s in ("bid", "ask")]
    long = rows.select(*keys, *order, "place", F.concat(*sides).alias("d")).select(*keys, *order, "place", F.posexplode("d").alias("level", "d"))
    mean = D.weighted_mean(long, "d", [*keys, "level"], order, span)
    gap = F.when(F.col("place") >= quiet, (F.col("d") - F.col("ewm")) * (F.col("d") - F.col("ewm")) / (F.col("ewm") + B.EPS)).otherwise(0.0)
    return mean.groupBy(*keys, *order).agg(F.sum(gap).alias("surprise_score"))


def feature_matrix(book: DataFrame, keys, order, horizons: Sequence[int] = (10, 30, 100, 500, 1000), *, quiet: int = 50, rows: int = 200, components: int = 8, windows: Sequence[int] = ()) -> DataFrame:
    """keys, order, all static, dynamic and hidden features and the targets of a normalised book, one row a snapshot; infinite values are null.

    Among them spread, rel_spread, the costs of sweeping either side, surprise_score (0 on the first `quiet` snapshots),
    mm_inventory_pressure (the signed net flow, decayed over a span of 100) and pca_factor_1 to `components` of the book's shape over
    the `rows` snapshots before; no factors with components = 0. With windows, <feature>_<mean, sd, skew or slope>_<window> of all
    features (slope of trended ones only), as rolling_pyramid() gives them in long form.
    """
    full = B.targets(B.hidden_features(B.dynamic_features(B.static_features(B.impact(book)), keys, order), keys, order), keys, order, horizons)
    full = D.weighted_mean(full, "net_flow_signed", keys, order, 100).withColumnRenamed("ewm", "mm_inventory_pressure").drop("ewm_sd")
    own = [c for c in order if c not in keys]
    found = [c for c in full.columns if c not in {*book.columns, *keys, *order}]
    out = full.select(*keys, *own, *[finite(F.col(c)).alias(c) for c in ["spread", "rel_spread", *found]]).join(surprise(book, keys, order, quiet=quiet), [*keys, *own])
    if components:
        shape = book.select(*keys, *own, F.concat("bid_size_norm", "ask_size_norm", "bid_price_norm", "ask_price_norm").alias("_shape"))
        factors = rolling_factors(shape, "_shape", 4 * B.LEVELS, keys, order, rows, components)
        out = out.join(factors.select(*keys, *own, *[F.col("factors")[i].alias(f"pca_factor_{i + 1}") for i in range(components)]), [*keys, *own])
    if windows:
        named = sorted(c for c in out.columns if c not in {*keys, *own} and not c.startswith(("ret_", "direction_", "vol_")))
        stats = ("mean", "sd", "skew", "slope")
        long = rolling_pyramid(out, named, keys, order, windows)
        wide = long.groupBy(*keys, *own).agg(F.sort_array(F.collect_list(F.struct("feature", "window", *stats))).alias("_m"))
        places = {(c, w): i for i, (c, w) in enumerate((c, w) for c in named for w in sorted(windows))}
        wide = wide.select(*keys, *own, *[F.col("_m")[i][stat].alias(f"{c}_{stat}_{w}") for (c, w), i in places.items() for stat in stats if stat != "slope" or c in TRENDED])
        out = out.join(wide, [*keys, *own])
    return out


def t_tail(t: float, freedom: float) -> float:
    """The probability that a t statistic is at least as far from 0, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        a, b, x = b, a, 1 - x
    term, value, c = 1.0, 1.0, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 500):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + part * d), 1 + part / c
            term = c * d
            value *= term
        if abs(term - 1) < 1e-14:
            break
    tail = front * value / a
    return 1 - tail if turned else tail


def information_report(df: DataFrame, features, target: str, level: float = 0.05) -> DataFrame:
    """One row a feature of at least 30 complete rows, by falling size of the rank correlation: feature, n, ic, t, p_value, significant. A constant feature has no correlation and no row."""
    rows = information(df, features, target).collect()  # as many rows as there are features
    out = []
    for r in rows:
        if r.ic is not None:
            p = 0.0 if r.t is None else t_tail(r.t, r.n - 2)
            out.append((r.feature, r.n, float(r.ic), None if r.t is None else float(r.t), round(p, 4), p < level))
    out.sort(key=lambda r: (-abs(r[2]), r[0]))
    return df.sparkSession.createDataFrame(out, "feature string, n long, ic double, t double, p_value double, significant boolean")


def clean_features(df: DataFrame, features, target: str, most_alike: float = 0.85, least_ic: float = 0.01) -> list[str]:
    """The names of the features to keep: significant ones of at least `least_ic`, from the most informative on, each without those before it that it is correlated with beyond `most_alike`. All of them if none is significant.

    The correlations come from one aggregation; only a number a pair of columns reaches the driver.
    """
    good = [r.feature for r in information_report(df, features, target).collect() if r.significant and abs(r.ic) >= least_ic]
    if not good:
        return list(features)
    whole = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in good))
    alike = {frozenset((r.a, r.b)): abs(r.corr) for r in correlations(whole, good).collect() if r.corr is not None} if len(good) > 1 else {}
    keep: list[str] = []
    for c in good:
        if all(alike.get(frozenset((c, k)), 0.0) <= most_alike for k in keep):
            keep.append(c)
    return keep

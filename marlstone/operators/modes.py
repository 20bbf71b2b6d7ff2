"""Empirical modes of series: sifted, with ensembles of noise, merged by their disorder, and forecast one by one.

A series is one row with its values in order, as an envelope runs through all of them. What multiplies the work is rows: each
trial of an ensemble is a row of its own, dealt to any task, and trials come together by a grouped mean over
(series, place).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import cut, joined
from marlstone.functions.stored import stored
from marlstone.operators.chunks import SHARE
from marlstone.operators.signals import merge_alike, permutation_entropy


def spline(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """On 0..n-1, the cubic spline through (at, values) whose first and last two pieces are one cubic each; the end pieces go on beyond the ends. Through three points a parabola, through two a line."""
    if len(at) < 4:
        return np.polyval(np.polyfit(at - at[0], values, len(at) - 1), np.arange(n) - at[0])
    h, slope = np.diff(at).astype(float), np.diff(values) / np.diff(at)
    below, main, above, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    # The curvatures at both ends follow from their neighbours, as the third derivative does not change at the second point from either end.
    main[0] += h[0] * (h[0] + h[1]) / h[1]
    above[0] -= h[0] * h[0] / h[1]
    main[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    below[-1] -= h[-1] * h[-1] / h[-2]
    a, b, c, d = below.tolist(), main.tolist(), above.tolist(), right.tolist()
    for i in range(1, len(b)):
        w = a[i] / b[i - 1]
        b[i] -= w * c[i - 1]
        d[i] -= w * d[i - 1]
    inner = d
    inner[-1] /= b[-1]
    for i in range(len(b) - 2, -1, -1):
        inner[i] = (inner[i] - c[i] * inner[i + 1]) / b[i]
    first = ((h[0] + h[1]) * inner[0] - h[0] * inner[1]) / h[1]
    last = ((h[-1] + h[-2]) * inner[-1] - h[-1] * inner[-2]) / h[-2]
    curve = np.array([first, *inner, last])
    t = np.arange(n)
    j = np.clip(np.searchsorted(at, t, side="right") - 1, 0, len(at) - 2)
    x = t - at[j]
    return values[j] + x * (slope[j] - h[j] * (2 * curve[j] + curve[j + 1]) / 6 + x * (curve[j] / 2 + x * (curve[j + 1] - curve[j]) / (6 * h[j])))


def turns(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the peaks and of the lows."""
    bend = np.diff(np.sign(np.diff(v)))
    return np.flatnonzero(bend < 0) + 1, np.flatnonzero(bend > 0) + 1


def sifted(v: np.ndarray, rounds: int = 10, stop: float = 0.2) -> np.ndarray:
    """The fastest mode: the mean of the envelopes is taken off until it holds less than `stop` of the square sum (it then stays on), or too few turns are left."""
    for _ in range(rounds):
        peaks, lows = turns(v)
        if min(len(peaks), len(lows)) < 2:
            break
        middle = (spline(peaks, v[peaks], len(v)) + spline(lows, v[lows], len(v))) / 2
        power = v @ v
        if power == 0 or middle @ middle < stop * power:
            break
        v = v - middle
    return v


def decomposed(v: np.ndarray, most: int, rounds: int = 10, stop: float = 0.2) -> list[np.ndarray]:
    """At most `most` modes, fastest first, and the rest, which has too few turns or runs one way."""
    out = []
    while len(out) < most and min(map(len, turns(v))) >= 2:
        out.append(sifted(v, rounds, stop))
        v = v - out[-1]
        steps = np.diff(v)
        if (steps > 0).all() or (steps < 0).all():
            break
    return [*out, v]


def height_dimension(v: np.ndarray) -> float:
    """The dimension by counts of the boxes of height that a series visits, at 2, 4, ..., 256 boxes."""
    unit = (v - v.min()) / (v.max() - v.min() + 1e-9)
    sizes = 2 ** np.arange(1, 9)
    counts = [len(np.unique(np.minimum((unit * n).astype(int), n - 1))) for n in sizes]
    return float(np.polyfit(np.log(sizes), np.log(counts), 1)[0])


def known(v: np.ndarray) -> np.ndarray:
    """Values that are not finite as the last finite one before, 0 at first."""
    at = np.maximum.accumulate(np.where(np.isfinite(v), np.arange(len(v)), -1))
    return np.where(at >= 0, v[at], 0.0)


def _as_rows(df: DataFrame, value: str, keys, order) -> DataFrame:
    """(key_0, ..., v, rows): one row a series, its values (missing ones as the one before, 0 at first) and its rows in order."""
    named = df.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.struct(F.struct(*order).alias("at"), F.col(value).cast("double").alias("v"), F.struct("*").alias("row")).alias("item"))
    packed = named.groupBy(*[f"key_{i}" for i in range(len(keys))]).agg(F.sort_array(F.collect_list("item")).alias("items"))

    def filled(series: pa.Array) -> pa.Array:
        return joined([{"v": known(v)} for v in cut(series)], {"v": "double"}).field("v")

    return packed.select(*[f"key_{i}" for i in range(len(keys))], F.monotonically_increasing_id().alias("series"), F.arrow_udf(filled, "array<double>")(F.transform("items", lambda x: x["v"])).alias("v"), F.transform("items", lambda x: x["row"]).alias("rows"))


def mode_decomposition(df: DataFrame, value: str, keys, order, most: int = 9, rounds: int = 10, stop: float = 0.2, trials: int = 0, noise: float = 0.2, least_dimension: float = 1.22, abnormal: int = 9) -> DataFrame:
    """Adds modes: at each row the values of the intrinsic modes, fastest first, and the rest last; they sum to the value.

    With trials, rough modes are taken off first, at most `abnormal` of them: each is the mean over `trials` pairs of what sifting gives for
    the series with and without the sign of the same normal noise turned, `noise` strong in the series' deviations, and counts as long as its
    dimension is over least_dimension. The noise follows from series and trial, so reruns agree. Then at most `most` modes of what is left.
    Missing values count as the one before. All arrays have abnormal + most + 1 places (most + 1 without trials), 0 where there is no mode.
    """
    table = stored(_as_rows(df, value, keys, order), "series")
    names = [c for c in table.columns if c.startswith("key_")]
    taken = abnormal if trials else 0
    total = table.agg(F.sum(F.size("v"))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = table.select("series", F.xxhash64(*names, F.lit(7)).alias("seed"), F.col("v").alias("rest"), F.array().cast("array<array<double>>").alias("found"), F.lit(bool(trials)).alias("going"))

    def pair(rest: pa.Array, seed: pa.Array, trial: pa.Array) -> pa.Array:
        out = []
        for v, s, t in zip(cut(rest), seed.to_pylist(), trial.to_pylist()):
            e = np.random.default_rng([abs(int(s)), int(t)]).standard_normal(len(v)) * noise * v.std()
            out.append({"v": (sifted(v + e, rounds, stop) + sifted(v - e, rounds, stop)) / 2})
        return joined(out, {"v": "double"}).field("v")

    for turn in range(taken):
        state = stored(state, "modes")
        runs = state.filter("going").select("series", "rest", F.hash("seed", F.lit(turn)).cast("long").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
        if not runs.limit(1).count():
            break
        modes = runs.repartition(max(least, -(-total * trials // SHARE)), "series", "trial").select("series", F.posexplode(F.arrow_udf(pair, "array<double>")("rest", "seed", "trial")).alias("i", "x"))
        mean = modes.groupBy("series", "i").agg(F.avg("x").alias("x")).groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mode"))
        rough = F.pandas_udf(lambda s: pd.Series([height_dimension(np.asarray(v, float)) > least_dimension for v in s]), "boolean")
        judged = mean.select(F.col("series").alias("own"), "mode", rough("mode").alias("rough")).hint("merge")
        both = state.join(judged, F.col("series") == F.col("own"), "left").withColumn("rough", F.coalesce("rough", F.lit(False)))
        state = both.select(
            "series", "seed", F.when(F.col("rough"), F.zip_with("rest", "mode", lambda a, b: a - b)).otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("rough"), F.concat("found", F.array("mode"))).otherwise(F.col("found")).alias("found"), F.col("rough").alias("going"),
        )

    def whole(rest: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for v, rough in zip(cut(rest), cut(found)):
            *modes, left = decomposed(v, most, rounds, stop)
            modes = [*rough.reshape(-1, len(v)), *modes]
            out.append({"modes": np.stack([*modes, *[np.zeros(len(v))] * (taken + most - len(modes)), left], axis=1)})
        return joined(out, {"modes": "array<double>"}).field("modes")

    # Stored, so that later steps, which read the modes more than once, do not sift again.
    dealt = state.repartition(max(least, -(-total // SHARE)), "series")
    split = stored(dealt.select(F.col("series").alias("own"), F.arrow_udf(whole, "array<array<double>>")("rest", F.flatten("found")).alias("modes")), "split")
    one = table.join(split, F.col("series") == F.col("own")).select(F.explode(F.arrays_zip("rows", "modes")).alias("one"))
    return one.select(*[F.col(f"one.rows.`{c}`") for c in df.columns if c != "modes"], F.col("one.modes").alias("modes"))


def merged_modes(modes: DataFrame, keys, order, tolerance: float = 0.1, m: int = 3) -> DataFrame:
    """keys, order, component, x: the modes of mode_decomposition() in long form, neighbours whose permutation entropies differ by less than `tolerance` added up. Modes that are 0 throughout a series are left out; series too short for an entropy are one component."""
    long = modes.select(*keys, *[c for c in order if c not in keys], F.posexplode("modes").alias("mode", "x"))
    used = Window.partitionBy(*keys, "mode")
    long = stored(long.withColumn("_used", F.max(F.abs("x")).over(used)).filter("_used > 0").drop("_used"), "long")
    disorder = merge_alike(permutation_entropy(long, "x", [*keys, "mode"], order, m), keys, "mode", "entropy", tolerance)
    # A row a series and mode grows with the table: never gathered in the driver to be broadcast.
    numbered = long.join(disorder.select(*keys, "mode", "merged").hint("merge"), [*keys, "mode"], "left")
    return numbered.groupBy(*keys, *[c for c in order if c not in keys], F.coalesce("merged", F.lit(0)).cast("int").alias("component")).agg(F.sum("x").alias("x"))


def component_forecasts(components: DataFrame, keys, order, lags: int = 5, share: float = 0.8, ridge: float = 1e-3) -> DataFrame:
    """keys, order, actual, guess, is_train: a component's next value is forecast from its `lags` values before, and the forecasts of a row's components are added up.

    Each component is scaled by mean and deviation over the first `share` of its series, on which one regression is fitted for all of them,
    with coefficients of its own for each number of component (numbers from the ninth on share theirs). Rows with less than `lags` before them are left out.
    """
    own = [c for c in order if c not in keys]
    components = stored(components, "components")  # read by the fit and by the forecasts
    w = Window.partitionBy(*keys, "component").orderBy(*order)
    whole = Window.partitionBy(*keys, "component")
    rows = components.withColumn("is_train", F.row_number().over(w) <= F.floor(share * F.count("*").over(whole)))
    rows = rows.withColumns({"m": F.avg(F.when(F.col("is_train"), F.col("x"))).over(whole), "sd": F.stddev_pop(F.when(F.col("is_train"), F.col("x"))).over(whole)})
    rows = rows.withColumn("z", F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.nullif("sd", F.lit(0.0))), F.lit(0.0)))
    rows = rows.withColumn("past", F.array(F.lit(1.0), *[F.lag("z", k).over(w) for k in range(1, lags + 1)])).filter(F.forall("past", lambda x: x.isNotNull()))
    kinds = 9
    kind = F.least(F.col("component"), F.lit(kinds - 1))
    crossed = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(kinds - 1)), lambda k: F.transform("past", lambda x: F.when(kind == k, x).otherwise(0.0))))
    rows = rows.withColumn("features", array_to_vector(crossed))
    model = LinearRegression(featuresCol="features", labelCol="z", predictionCol="said", fitIntercept=False, regParam=ridge, standardization=False, solver="normal").fit(rows.filter("is_train"))
    said = model.transform(rows).withColumn("guess", F.col("said") * F.coalesce("sd", F.lit(0.0)) + F.col("m"))
    return said.groupBy(*keys, *own).agg(F.sum("x").alias("actual"), F.sum("guess").alias("guess"), F.min("is_train").alias("is_train"))

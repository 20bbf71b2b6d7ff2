"""Sequential models, one series a group: Spark deals the series out, numpy runs the recursion within each.

A series must fit into a task; a longer one is to be cut by a further key such as the day. Null and non-finite inputs
are left out before fitting. A series too short for a model gives null columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType


def per_series(df: DataFrame, keys, order, added: dict, fit) -> DataFrame:
    """Adds columns (name: type) from fit(rows in order) -> {name: values}."""
    schema = StructType(list(df.schema))
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return df.groupBy(*keys).applyInPandas(lambda pdf: (p := pdf.sort_values(list(order), kind="stable")).assign(**fit(p)), schema)


def fluctuation_exponents(df: DataFrame, value: str, keys, order, qs=(-5, -3, -1, 1, 2, 3, 5), smallest: int = 8, scales: int = 6) -> DataFrame:
    """Per key: n and h, the array of generalised Hurst exponents by detrended fluctuation analysis of the values' profile: straight lines are taken out of segments from both ends. Null below 4 * smallest values."""

    def fit(pdf):
        v = pdf.sort_values(list(order), kind="stable")[value].to_numpy(float)
        v = v[np.isfinite(v)]
        h, n = None, len(v)
        if n >= 4 * smallest and v.std() > 0:
            profile = np.cumsum(v - v.mean())
            sizes = np.unique(np.geomspace(smallest, n // 4, scales).astype(int))
            logs = []
            for s in sizes:
                parts = np.concatenate([profile[: n // s * s].reshape(-1, s), profile[n - n // s * s :].reshape(-1, s)])
                t = np.arange(s) - (s - 1) / 2
                left = parts - parts.mean(1, keepdims=True) - np.outer(parts @ t / (t @ t), t)
                f2 = np.maximum((left**2).mean(1), 1e-300)
                logs.append([0.5 * np.log(f2).mean() if q == 0 else np.log((f2 ** (q / 2)).mean()) / q for q in qs])
            if len(sizes) > 1:
                h = np.polyfit(np.log(sizes), np.array(logs), 1)[0].tolist()
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": n, "h": h}])

    schema = StructType([df.schema[k] for k in keys]).add("n", "long").add("h", ArrayType(DoubleType()))
    return df.groupBy(*keys).applyInPandas(fit, schema)


def wavelet_energies(df: DataFrame, vector: str, levels: int = 5) -> DataFrame:
    """Adds energies: the mean square of the Haar details at each level, finest first; a level of odd length loses its last element, one of fewer than two gives null."""
    half = lambda a, sign: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(a) / 2).cast("int"))), lambda i: (F.try_element_at(a, 2 * i - 1) + sign * F.try_element_at(a, 2 * i)) / 2**0.5)
    out, names = df.withColumn("_a0", F.col(vector)), []
    for i in range(levels):
        a = F.col(f"_a{i}")
        out = out.withColumns({f"_d{i}": half(a, -1), f"_a{i + 1}": half(a, 1)})
        names.append(F.when(F.size(a) >= 2, F.aggregate(f"_d{i}", F.lit(0.0), lambda s, x: s + x * x) / F.size(f"_d{i}")))
    return out.withColumn("energies", F.array(*names)).drop(*[f"_a{i}" for i in range(levels + 1)], *[f"_d{i}" for i in range(levels)])


def metaorders(df: DataFrame, time: str, score: str, sign: str, keys, order, start: float = 0.98, stop: float = 0.85, gap: float = 2.0, least: int = 5, lasting: float = 5.0) -> DataFrame:
    """Per key: t0, t1, sign, n_child of stretches that begin where the score's size reaches its `start` quantile and end below its `stop` quantile or at a change of sign; those of one sign at most `gap` seconds apart are one; only those of `least` rows and `lasting` seconds stay. Windows only."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    bounds = df.groupBy(*keys).agg(F.percentile(F.abs(score), F.array(F.lit(stop), F.lit(start))).alias("_q"))
    rows = df.join(bounds, list(keys)).withColumn("_s", F.abs(score))
    # Hysteresis: the last row that decides, above the upper bound or below the lower one, tells the state.
    rows = rows.withColumn("_on", F.last(F.when(F.col("_s") >= F.col("_q")[1], True).when(F.col("_s") < F.col("_q")[0], False), ignorenulls=True).over(upto)).filter("_on")
    new = F.coalesce(((F.col(time) - F.lag(time).over(w)) > gap) | (F.col(sign) != F.lag(sign).over(w)), F.lit(True)).cast("int")
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(upto))
    runs = rows.groupBy(*keys, "_run").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.min(sign).alias("sign"), F.count("*").alias("n_child"))
    return runs.filter((F.col("n_child") >= least) & (F.col("t1") - F.col("t0") >= lasting)).drop("_run")

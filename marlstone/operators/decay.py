"""Exponentially decayed sums and fits without a scan of the whole series.

Time is cut into buckets of 20 time constants. Within a bucket a decayed sum is a prefix sum of rescaled amounts; what
two buckets back is the last that is added, as what lies before weighs less than exp(-40). So a series is spread over
as many tasks as it has buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.windows import decayed_mean

SPAN = 20.0


def power_law_mixture(eps: float = 1.0, count: int = 10, shortest: float = 0.1, longest: float = 1000.0, points: int = 500, ridge: float = 1e-8) -> tuple[list[float], list[float]]:
    """(time constants, coefficients): `count` exponentials, evenly spaced in log time, that approximate 1 / sqrt(t + eps) by ridge least squares."""
    import numpy as np

    taus = np.geomspace(shortest, longest, count)
    t = np.geomspace(shortest / 10, longest, points)
    basis = np.exp(-t[:, None] / taus)
    return taus.tolist(), np.linalg.solve(basis.T @ basis + ridge * np.eye(count), basis.T @ (1 / np.sqrt(t + eps))).tolist()


def decayed_flow(df: DataFrame, time: str, amount: str, keys, row_id: str, taus: Sequence[float], weights: Sequence[float]) -> DataFrame:
    """Per row: keys, row_id, flow, the sum over mixtures k of weights[k] times the sum of amounts up to the row, each decayed by exp(-age / taus[k]). `time` is in seconds; of rows at one time, later ids see earlier ones. A null amount counts as 0."""
    mixed = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(float(t)).alias("_tau"), F.lit(float(c)).alias("_weight")) for k, (t, c) in enumerate(zip(taus, weights))]))
    rows = df.select(*keys, F.col(row_id), F.col(time).alias("_t"), F.coalesce(F.col(amount), F.lit(0.0)).alias("_q"), mixed.alias("_m")).select(*keys, row_id, "_t", "_q", "_m.*")
    rows = rows.withColumn("_b", F.floor(F.col("_t") / (SPAN * F.col("_tau")))).withColumn("_x", F.col("_t") / F.col("_tau") - SPAN * F.col("_b"))
    group = [*keys, "_k", "_b"]
    rows = rows.withColumn("_own", F.sum(F.col("_q") * F.exp("_x")).over(Window.partitionBy(*group).orderBy("_t", row_id).rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*group).agg(F.sum(F.col("_q") * F.exp(F.col("_x") - SPAN)).alias("_end"))
    back = lambda n: ends.select(*keys, "_k", (F.col("_b") + n).alias("_b"), (F.col("_end") * math.exp(-SPAN * (n - 1))).alias(f"_e{n}"))
    rows = rows.join(back(1), group, "left").join(back(2), group, "left")
    value = F.exp(-F.col("_x")) * (F.col("_own") + F.coalesce("_e1", F.lit(0.0)) + F.coalesce("_e2", F.lit(0.0)))
    return rows.groupBy(*keys, row_id).agg(F.sum(F.col("_weight") * value).alias("flow"))


def weighted_mean(df: DataFrame, value: str, keys, order, span: float) -> DataFrame:
    """Adds ewm: the mean with weights (1 - alpha)^age, alpha = 2 / (span + 1), over the values so far, and ewm_sd, the bias-corrected deviation; null for a single value. Null values have no age.

    The sums of weights have closed forms. Those of values are running sums of rescaled values within buckets, over which weights fall by
    exp(-SPAN), and what the two buckets before hold; so a row costs the same at every span.
    """
    keep = 1 - 2 / (span + 1)
    rows_of = max(1, math.floor(SPAN / -math.log(keep))) if keep > 0 else 1
    given = df.drop("ewm", "ewm_sd").columns
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(F.struct(*given).alias("_row"), F.struct(F.lit(0), *keys).alias("_k"), F.struct(*order).alias("_at"), F.col(value).cast("double").alias("_v"), F.count(value).over(running).alias("_n"))
    rows = rows.withColumns({"_b": F.floor((F.col("_n") - 1) / rows_of), "_i": F.pmod(F.col("_n") - 1, F.lit(rows_of))})
    power = lambda e: F.pow(F.lit(keep), e) if keep > 0 else F.when(e == 0, 1.0).otherwise(0.0)
    terms = {"x": F.col("_v") / power(F.col("_i")), "xx": F.col("_v") * F.col("_v") / power(F.col("_i"))}
    group = ["_k", "_b"]
    ends = rows.filter("_v IS NOT NULL").groupBy(*group).agg(*[(F.sum(e) * keep ** (rows_of - 1)).alias(f"end_{c}") for c, e in terms.items()])
    w_bucket = Window.partitionBy("_k").orderBy("_b")  # every bucket up to the last holds values
    before = {c: F.coalesce(F.lag(f"end_{c}").over(w_bucket), F.lit(0.0)) + F.coalesce(F.lag(f"end_{c}", 2).over(w_bucket), F.lit(0.0)) * keep**rows_of for c in terms}
    ends = ends.select(*group, *[e.alias(f"before_{c}") for c, e in before.items()])
    own = {f"own_{c}": F.sum(e).over(Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) for c, e in terms.items()}
    rows = rows.withColumns(own).join(ends, group, "left")
    x, xx = (power(F.col("_i")) * (F.col(f"own_{c}") + keep * F.col(f"before_{c}")) for c in terms)
    w, w2 = (1 - power(F.col("_n"))) / (1 - keep), (1 - power(2 * F.col("_n"))) / (1 - keep * keep)
    rows = rows.select("_row.*", F.when(F.col("_n") > 0, x / w).alias("ewm"), F.when(F.col("_n") > 0, xx / w).alias("_m2"), F.when(F.col("_n") > 1, F.try_divide(w * w, w * w - w2)).alias("_bias"))
    sd = F.sqrt(F.greatest(F.col("_m2") - F.col("ewm") * F.col("ewm"), F.lit(0.0)) * F.col("_bias"))
    return rows.withColumn("ewm_sd", sd).drop("_m2", "_bias")


def decayed_sums(df: DataFrame, values: dict[str, str], keys, order, keep: float, number: Column | None = None) -> DataFrame:
    """Adds a column for each of `values` (name: column): the sum of the column up to the row, a row's value weighing keep^age, 0 < keep < 1. Nulls count 0, and rows where all of `values` are null have no age.

    Running sums of rescaled values within buckets, over which weights fall by exp(-SPAN), and what the two buckets before hold, as in weighted_mean().
    number: how many rows with an age there are up to the row, where that is known.
    """
    rows_of = max(1, math.floor(SPAN / -math.log(keep)))
    if number is None:
        number = F.count(F.coalesce(*values.values())).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    given = [c for c in df.columns if c not in values]
    rows = df.select(F.struct(*given).alias("_row"), F.struct(F.lit(0), *keys).alias("_k"), F.struct(*order).alias("_at"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(values.values())], number.alias("_n"))
    rows = rows.withColumns({"_b": F.floor((F.col("_n") - 1) / rows_of), "_i": F.pmod(F.col("_n") - 1, F.lit(rows_of))})
    within = Window.partitionBy("_k", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    terms = [F.col(f"_v{i}") / F.pow(F.lit(keep), F.col("_i")) for i in range(len(values))]
    ends = rows.groupBy("_k", "_b").agg(*[(F.sum(t) * keep**rows_of).alias(f"_end{i}") for i, t in enumerate(terms)])
    w_bucket = Window.partitionBy("_k").orderBy("_b")  # every bucket up to the last has rows; what comes before the first row with an age is 0
    end = lambda i, back: F.coalesce(F.lag(f"_end{i}", back).over(w_bucket), F.lit(0.0))
    ends = ends.select("_k", "_b", *[(end(i, 1) + end(i, 2) * keep**rows_of).alias(f"_before{i}") for i in range(len(values))])
    rows = rows.withColumns({f"_own{i}": F.sum(t).over(within) for i, t in enumerate(terms)}).join(ends, ["_k", "_b"], "left")
    return rows.select("_row.*", *[(F.pow(F.lit(keep), F.col("_i")) * (F.col(f"_own{i}") + F.col(f"_before{i}"))).alias(n) for i, n in enumerate(values)])


def online_slope(df: DataFrame, x: str, y: str, keys, order, alpha: float = 0.05, ridge: float = 1e-6) -> DataFrame:
    """Adds beta: the decayed mean of x * y over that of x * x plus `ridge`, rows before the current one only, so that beta * x is a forecast."""
    df = df.withColumns({"_xx": F.col(x) * F.col(x), "_xy": F.col(x) * F.col(y)})
    df = df.withColumns({"_mxx": decayed_mean("_xx", keys, order, alpha), "_mxy": decayed_mean("_xy", keys, order, alpha)})
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("beta", F.lag("_mxy").over(w) / (F.lag("_mxx").over(w) + ridge)).drop("_xx", "_xy", "_mxx", "_mxy")

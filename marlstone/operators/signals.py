"""Measures of whole series: ordinal entropy, box counts, quantiles, spectra of deviations; and component merging."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.arrays import ordinal_pattern


def permutation_entropy(df: DataFrame, value: str, keys, order, m: int = 3, delay: int = 1) -> DataFrame:
    """Per key: n patterns and entropy in bits of the ordinal patterns of m values, `delay` rows apart. Series shorter than that have no row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = F.array(*[F.lead(value, i * delay).over(w) for i in range(m)])
    rows = df.filter(F.col(value).isNotNull()).select(*keys, ahead.alias("_a")).filter(F.size(F.filter("_a", lambda x: x.isNull())) == 0)
    counts = rows.groupBy(*keys, ordinal_pattern(F.col("_a")).alias("pattern")).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.sum("c").alias("n"), (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def box_dimension(df: DataFrame, value: str, keys, sizes=(2, 4, 8, 16, 32, 64, 128, 256)) -> DataFrame:
    """Per key: dimension, the slope of log occupied boxes on log number of boxes when the values' range is cut into 2, 4, .. boxes. 0 for a constant series.

    Boxes are counted as distinct ones of the finest cut, which nests in the others: at most 256 rows a key are shuffled on.
    """
    finest = max(sizes)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    unit = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)
    boxes = df.filter(F.col(value).isNotNull()).join(span, list(keys)).select(*keys, F.least(F.floor(unit * finest), F.lit(finest - 1)).cast("int").alias("box")).distinct()
    counts = boxes.groupBy(*keys).agg(*[F.count_distinct(F.floor(F.col("box") / (finest // n))).alias(f"n{n}") for n in sizes])
    x = [math.log(n) for n in sizes]
    mx = sum(x) / len(x)
    sxx = sum((v - mx) ** 2 for v in x)
    terms = [F.lit((v - mx) / sxx) * F.ln(f"n{n}") for v, n in zip(x, sizes)]
    return counts.select(*keys, sum(terms[1:], terms[0]).alias("dimension"))


def quantiles(df: DataFrame, value: str, keys, at=(0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Per key: n and the exact quantiles q01, q25, .. with linear interpolation, from counted ranges; null for a key without values."""
    from marlstone.operators.running import exact_quantiles

    counts = df.groupBy(*keys).agg(F.count(value).alias("n"))
    found = exact_quantiles(df, value, keys, at, "_q")
    named = [F.col(k).alias(f"_own_{i}") for i, k in enumerate(keys)]
    q = counts.join(found.select(*named, "_q"), [F.col(k).eqNullSafe(F.col(f"_own_{i}")) for i, k in enumerate(keys)], "left")
    return q.select(*keys, "n", *[F.col("_q")[i].alias(f"q{round(100 * p):02d}") for i, p in enumerate(at)])


def plotting_quantile(df: DataFrame, value: str, keys, p: float, a: float = 0.4, b: float = 0.4) -> DataFrame:
    """Per key: q, the quantile at plotting positions (k - a) / (n + 1 - a - b), held to the least and greatest value.

    Only the two ranks that bracket the quantile are kept after ranking.
    """
    n = F.count(value).over(Window.partitionBy(*keys))
    ranked = df.filter(F.col(value).isNotNull()).select(*keys, value, n.alias("_n"), F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("_k"))
    place = F.col("_n") * p + a + p * (1 - a - b)
    low = F.greatest(F.lit(1), F.least(F.floor(place), F.col("_n") - 1)).cast("int")
    g = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place - low))
    near = ranked.withColumns({"_low": low, "_g": g}).filter("_k = _low OR _k = _low + 1")
    return near.groupBy(*keys).agg(F.sum(F.when(F.col("_n") == 1, F.col(value)).when(F.col("_k") == F.col("_low"), (1 - F.col("_g")) * F.col(value)).otherwise(F.col("_g") * F.col(value))).alias("q"))


def merge_alike(components: DataFrame, keys, index: str, measure: str, tolerance: float = 0.1) -> DataFrame:
    """Adds merged: neighbours in `index` whose measures differ by less than `tolerance` share a number."""
    w = Window.partitionBy(*keys).orderBy(index)
    new = F.coalesce((F.abs(F.col(measure) - F.lag(measure).over(w)) >= tolerance).cast("int"), F.lit(0))
    return components.withColumn("_new", new).withColumn("merged", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def errors(df: DataFrame, truth: str, guess: str, keys) -> DataFrame:
    """Per key: mae, rmse, mape (shares of |truth| + 1e-9) and r2 (null for a constant truth)."""
    e = F.col(truth) - F.col(guess)
    rows = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / (F.abs(truth) + 1e-9)).alias("mape"),
        (1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(truth) * F.count("*"), F.lit(0.0)))).alias("r2"),
    )

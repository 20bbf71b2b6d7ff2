"""Generalised Hurst exponents over sliding windows, by multifractal detrended fluctuation analysis.

A segment of a window's profile is detrended by its least-squares line, and what is left needs only the sums of y, t y and y y
over the segment: differences of running sums over the window. Lines take out whatever is linear, so the mean that the
profile is taken about matters to no segment. Everything is built of DataFrame functions; rows are dealt out by
window, so a long series is spread over as many tasks as it has windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.running import row_numbers

QS = (-5, -3, -1, 1, 2, 3, 5)


def scales_of(rows: int, least: int = 10, count: int = 20) -> list[int]:
    """Lengths of segments, about evenly spaced in logarithm from `least` to a quarter of the window."""
    return sorted({int(s) for s in np.geomspace(least, rows // 4, count) + 1e-9})


def starts_of(rows: int, scale: int) -> list[int]:
    """Where segments begin that are laid from the front and from the back."""
    n = rows // scale
    return [k * scale for k in range(n)] + [rows - n * scale + k * scale for k in range(n)]


def sliding_windows(df: DataFrame, value: str, keys, order, rows: int, step: int) -> DataFrame:
    """(keys, window, j, y): the rows of each window (from 0; it begins at row window * step) with a place of its own, whose last row is not the series' last. Null values are no rows."""
    full = row_numbers(df.filter(F.col(value).isNotNull()).select(*keys, *[c for c in order if c not in keys], F.col(value).cast("double").alias("_y")), keys, order, "_i")
    last = F.floor((F.col("_i") - 1) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - rows) / step))
    out = full.withColumn("window", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))))
    return out.select(*keys, *[c for c in order if c not in keys], "window", (F.col("_i") - 1 - F.col("window") * step).cast("int").alias("j"), F.col("_y").alias("y"))


def window_exponents(df: DataFrame, value: str, keys, order, rows: int = 256, step: int = 60, qs: Sequence[float] = QS, scales: Sequence[int] | None = None) -> DataFrame:
    """Per key and window: window, the values of `order` at its last row, h (the exponents for each q, none of them 0), regime.

    A window holds `rows` values; one begins every `step` rows, as long as another row follows it. h is null where a segment lies on
    a line, as powers below 0 have no value there. scales: lengths of segments, by default scales_of(rows).
    """
    scales = list(scales or scales_of(rows))
    own = [c for c in order if c not in keys]
    inside = sliding_windows(df, value, keys, order, rows, step)
    whole = Window.partitionBy(*keys, "window")
    upto = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    # A window without a row after it is left out: the next row, if there is one, would be row `rows` of it.
    profile = inside.withColumn("m", F.avg("y").over(whole)).withColumn("p", F.sum(F.col("y") - F.col("m")).over(upto))
    sums = profile.withColumns({"s1": F.sum("p").over(upto), "s2": F.sum(F.col("j") * F.col("p")).over(upto), "s3": F.sum(F.col("p") * F.col("p")).over(upto)})
    packed = sums.groupBy(*keys, "window").agg(F.sort_array(F.collect_list(F.struct("j", "s1", "s2", "s3"))).alias("s"), F.max_by(F.struct(*own), "j").alias("at")).filter(F.size("s") == rows)
    series = row_counts(df, value, keys)
    packed = packed.join(series, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).filter(F.col("window") * step < F.col("_n") - rows)

    def left(scale):
        """The mean square about its line of the segment at u, or null if that is nothing but rounding."""
        def of(u):
            end, begin = F.get("s", u + scale - 1), F.get("s", u - 1)
            diff = lambda c: end[c] - F.coalesce(begin[c], F.lit(0.0))
            y, yy = diff("s1"), diff("s3")
            ty = diff("s2") - (u + (scale - 1) / 2) * y
            rest = yy - y * y / scale - ty * ty / (scale * (scale * scale - 1) / 12)
            return F.when(rest > 1e-11 * yy, rest / scale)

        return F.transform(F.array(*map(F.lit, starts_of(rows, scale))), of)

    cut = packed.select(*keys, "window", "at", F.array(*[left(s) for s in scales]).alias("f"))
    mean = lambda a, q: F.aggregate(a, F.lit(0.0), lambda t, x: t + F.pow(x, q / 2)) / F.size(a)
    logs = [math.log(s) for s in scales]
    centre = sum(logs) / len(logs)
    spread = sum((v - centre) ** 2 for v in logs)
    slope = lambda q: sum(((v - centre) / spread) * F.ln(mean(F.get("f", F.lit(i)), q)) / q for i, v in enumerate(logs))
    # Exploding a single element keeps later steps, which name h many times, from working it out as often.
    h = cut.select(*keys, "window", "at.*", F.explode(F.array(F.array(*[slope(float(q)) for q in qs]))).alias("h"))
    h = h.withColumn("h", F.when(F.forall("h", lambda x: x.isNotNull()), F.col("h")))
    near = lambda q: F.get("h", F.lit(min(range(len(qs)), key=lambda i: abs(qs[i] - q))))
    return h.withColumn("regime", regime(near(min(qs)), F.get("h", F.lit(len(qs) // 2)), near(max(qs))))


def row_counts(df: DataFrame, value: str, keys) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n"))


def regime(small, middle, large):
    """What the exponents of small, middling and large fluctuations say, the first rule that holds: large ones above 0.65 and middling ones above 0.5 a strong trend; small ones below 0.35 and middling ones below 0.5 a strong reversion; large ones above and small ones below 0.5 mixed; else random. Null is insufficient."""
    unknown = small.isNull() | middle.isNull() | large.isNull()
    return F.when(unknown, "insufficient").when((large > 0.65) & (middle > 0.5), "strong trend").when((small < 0.35) & (middle < 0.5), "strong reversion").when((large > 0.5) & (small < 0.5), "mixed").otherwise("random")

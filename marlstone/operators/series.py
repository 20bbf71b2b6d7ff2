"""Operators on keyed, ordered series, as window expressions and range joins that Catalyst plans.

Every operator takes the key columns and an order with a unique last column: Spark rows have no order of their own.
Null values are skipped as missing; a window with fewer than `min_periods` values gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def trailing(keys: Sequence[str], order: Sequence[str], rows: int) -> WindowSpec:
    """The current row and the rows before it, `rows` in all."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)


def at_least(n: int, value: str, window: WindowSpec, result: Column) -> Column:
    return F.when(F.count(value).over(window) >= n, result)


def rolling(df: DataFrame, value: str, keys, order, rows: int, min_periods: int | None = None) -> DataFrame:
    """Adds mean, sd (sample) and zscore of the trailing window; a constant window has no zscore."""
    w, n = trailing(keys, order, rows), min_periods or rows
    mean = at_least(n, value, w, F.avg(value).over(w))
    sd = at_least(max(n, 2), value, w, F.stddev_samp(value).over(w))
    return df.withColumns({"mean": mean, "sd": sd}).withColumn("zscore", F.when(F.col("sd") > 1e-9, (F.col(value) - F.col("mean")) / F.col("sd")))


def ohlc(df: DataFrame, value: str, keys, time: str, order: str, every: str) -> DataFrame:
    """Bars per key and interval: open, high, low, close and the number of values; empty intervals give no bar."""
    at = F.struct(time, order)
    return (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, F.date_trunc(every, time).cast(df.schema[time].dataType).alias("bar"))
        .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("n"))
    )


def padded(bars: DataFrame, keys, every: str) -> DataFrame:
    """Bars as ohlc() gives them, with a row for each interval of `every` (such as '1 hour') from a key's first bar to its last: an empty one has the close before it in all four prices and n 0."""
    spine = bars.groupBy(*keys).agg(F.min("bar").alias("begin"), F.max("bar").alias("until")).select(*keys, F.explode(F.sequence("begin", "until", F.expr(f"INTERVAL {every}"))).alias("bar"))
    close = F.last("close", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0))
    rows = spine.join(bars, [*keys, "bar"], "left").withColumn("close", close)
    return rows.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")} | {"n": F.coalesce("n", F.lit(0).cast("long"))})


def as_of(left: DataFrame, right: DataFrame, keys, time: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Adds to each left row the columns of the last right row of its key at or before its time, null if there is none.

    One shuffle by key and one sort: both sides lie in one ordered series and each left row takes the last non-null struct.
    """
    found = F.struct(*columns).alias("_found")
    own = left.select(F.struct("*").alias("_row"), *keys, time, F.col(order).alias("_order"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(found).schema["_found"].dataType).alias("_found"))
    theirs = right.select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), *keys, time, F.col(order).alias("_order"), F.lit(0).alias("_side"), found)
    w = Window.partitionBy(*keys).orderBy(time, "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    return own.unionByName(theirs).withColumn("_found", F.last("_found", ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", "_found.*")


def strength_index(df: DataFrame, value: str, keys, order, rows: int = 14) -> DataFrame:
    """Adds rsi over the last `rows` changes, or as many as there are, the first row's counting as 0: 100 without losses, null without gains and losses."""
    w = trailing(keys, order, rows)
    change = F.coalesce(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0))
    up, down = F.sum(F.greatest("_change", F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("_change"), F.lit(0.0))).over(w)
    return df.withColumn("_change", change).withColumn("rsi", 100 * F.try_divide(up, up + down)).drop("_change")


def wilder_index(df: DataFrame, value: str, keys, order, rows: int = 14) -> DataFrame:
    """As strength_index, with gains and losses averaged exponentially, each new change weighing 1 / rows."""
    from marlstone.operators.windows import decayed_mean

    change = F.coalesce(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0))
    df = df.withColumn("change_now", change).withColumns({"gain_now": F.greatest("change_now", F.lit(0.0)), "loss_now": F.greatest(-F.col("change_now"), F.lit(0.0))})
    up, down = (decayed_mean(c, keys, order, 1 / rows) for c in ("gain_now", "loss_now"))
    return df.withColumns({"gain_mean": up, "loss_mean": down}).withColumn("rsi", 100 * F.try_divide("gain_mean", F.col("gain_mean") + F.col("loss_mean"))).drop("change_now", "gain_now", "loss_now", "gain_mean", "loss_mean")


def rolling_line(df: DataFrame, x: str, y: str, keys, order, rows: int) -> DataFrame:
    """Adds slope and intercept of the least-squares line over the trailing window; null where x is constant or the window is not full."""
    w = trailing(keys, order, rows)
    mean_x, mean_y = F.avg(x).over(w), F.avg(y).over(w)
    together = F.sum(F.col(x) * F.col(y)).over(w) / rows - mean_x * mean_y
    slope = F.try_divide(together, F.nullif(F.round(F.sum(F.col(x) * F.col(x)).over(w) / rows - mean_x * mean_x, 12), F.lit(0.0)))
    full = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w) == rows
    return df.withColumn("slope", F.when(full, slope)).withColumn("intercept", F.when(full, F.avg(y).over(w) - F.col("slope") * F.avg(x).over(w)))


def first_barrier(df: DataFrame, value: str, keys, order, rows: int, up: float, down: float) -> DataFrame:
    """Adds label: 1 if the value rises by the share `up` before it falls by `down` within the next `rows` rows, -1 if it falls first, else 0."""
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, rows)
    gains = F.transform(F.collect_list(value).over(ahead), lambda v: F.try_divide(v, F.col(value)) - 1)
    hit = F.filter(gains, lambda g: (g >= up) | (g <= -down))
    first = F.try_element_at(hit, F.lit(1))
    return df.withColumn("label", F.when(first >= up, 1).when(first <= -down, -1).otherwise(0))


def winsorize(df: DataFrame, value: str, keys, low: float, high: float) -> DataFrame:
    """Adds clipped: the value held between its key's exact quantiles. These come from counted ranges, so no task sorts a whole key."""
    from marlstone.operators.running import with_quantiles

    bounded = with_quantiles(df, value, keys, (low, high))
    return bounded.withColumn("clipped", F.least(F.greatest(value, F.col("_q")[0]), F.col("_q")[1])).drop("_q")


def rank_correlation(df: DataFrame, x: str, y: str, by) -> DataFrame:
    """Per group of `by`: ic, Spearman's correlation with average ranks for ties, and n; null for fewer than three rows. No task holds a whole group."""
    from marlstone.operators.running import rank_moments

    ic = F.try_divide(F.col("sxy"), F.nullif(F.sqrt("sxx") * F.sqrt("syy"), F.lit(0.0)))
    return rank_moments(df, x, y, by).select(*by, "n", F.when(F.col("n") >= 3, ic).alias("ic"))


def volume_bars(df: DataFrame, price: str, quantity: str, keys, order, size: float) -> DataFrame:
    """Bars of about `size` of quantity per key: open, close, average price by quantity, quantity. A row belongs to the bar in which its quantity begins."""
    from marlstone.operators.running import share_of

    df = df.repartition(share_of(df), *keys)
    so_far = F.sum(quantity).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(quantity)
    at = F.struct(*order)
    return (
        df.withColumn("bar", F.floor(so_far / size)).groupBy(*keys, "bar")
        .agg(F.min_by(price, at).alias("open"), F.max_by(price, at).alias("close"), (F.sum(F.col(price) * F.col(quantity)) / F.sum(quantity)).alias("vwap"), F.sum(quantity).alias("quantity"))
    )

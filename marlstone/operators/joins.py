"""Joins on time: intervals, hopping windows and regular grids, as equi-joins on buckets so that no side is crossed with another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_intervals(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, begin: str, end: str, width: float) -> DataFrame:
    """Every (point, span) of one key with begin <= at <= end. `at`, `begin` and `end` are numbers; a span lies in each bucket of `width` that it touches, a point in one, so each pair meets once.

    Spans that end before they begin hold nothing. Keys beside the joined ones must have different names on the two sides.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    wide = spans.filter(F.col(begin) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    return points.withColumn("_bucket", bucket(at)).join(wide, [*keys, "_bucket"]).filter(F.col(at).between(F.col(begin), F.col(end))).drop("_bucket")


def hops(df: DataFrame, at: str, origin: Column, length: int, step: int) -> DataFrame:
    """Adds hop: a row for each window k with origin + k * step <= at <= origin + k * step + length, k >= 0. Both ends count, so a row on a boundary is in one more window."""
    since = F.col(at) - origin
    first = F.greatest(F.ceil((since - length) / step), F.lit(0)).cast("long")
    last = F.floor(since / step).cast("long")
    return df.withColumn("hop", F.explode(F.when(first <= last, F.sequence(first, last))))


def on_grid(df: DataFrame, keys, time: str, order: str, columns: Sequence[str], every: str) -> DataFrame:
    """Per key, a row for each multiple of `every` (such as '1 hour') from the first row's to the last row's: keys, grid and the columns of the last row at or before it.

    Grid rows and rows lie in one ordered series, so one sort fills them; rows before the first multiple serve only as what is known.
    """
    step = F.expr(f"INTERVAL {every}")
    seconds = F.expr(f"CAST(INTERVAL {every} AS INTERVAL SECOND)").cast("long")
    floor = lambda c: F.timestamp_seconds(F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1000000)) * seconds).cast("timestamp_ntz")
    spine = df.groupBy(*keys).agg(floor(F.min(time)).alias("_a"), floor(F.max(time)).alias("_b")).withColumn("grid", F.explode(F.sequence("_a", "_b", step)))
    found = F.struct(*columns).alias("_found")
    rows = df.select(*keys, F.col(time).alias("_at"), F.col(order).alias("_order"), F.lit(0).alias("_side"), found)
    marks = spine.select(*keys, F.col("grid").alias("_at"), F.lit(None).cast(df.schema[order].dataType).alias("_order"), F.lit(1).alias("_side"), F.lit(None).cast(df.select(found).schema["_found"].dataType).alias("_found"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.unionByName(marks).withColumn("_found", F.last("_found", ignorenulls=True).over(w))
    return filled.filter("_side = 1").select(*keys, F.col("_at").alias("grid"), "_found.*")


def daily_sums(df: DataFrame, keys, day: Column, value: str) -> DataFrame:
    """Per key and calendar day from its first to its last: total, 0 on days without rows."""
    sums = df.groupBy(*keys, day.cast("date").alias("day")).agg(F.sum(value).alias("total"))
    spine = sums.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return spine.join(sums, [*keys, "day"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def aggressor_signs(trades: DataFrame, quotes: DataFrame, keys, time: str, order: str, price: str, mid: str) -> DataFrame:
    """Adds mid and sign to each trade: 1 above the mid quoted last, -1 below, else by the tick against the trade before, else 1. A trade before all quotes takes the first one's mid.

    `quotes` carries the same key, time and order columns. A later trade is one with a greater (time, order).
    """
    from marlstone.operators.series import as_of

    firsts = quotes.groupBy(*keys).agg(F.min_by(mid, F.struct(time, order)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(time, order)
    seen = as_of(trades, quotes, keys, time, order, [mid]).join(firsts, list(keys), "left").withColumn(mid, F.coalesce(mid, "_first")).drop("_first")
    tick = F.signum(F.col(price) - F.lag(price).over(w))
    side = F.coalesce(F.nullif(F.signum(F.col(price) - F.col(mid)), F.lit(0.0)), F.nullif(tick, F.lit(0.0)), F.lit(1.0))
    return seen.withColumn("sign", side.cast("int"))

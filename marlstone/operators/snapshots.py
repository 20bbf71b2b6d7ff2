"""Features of hopping windows over an order book: what is last known at each price of a window, and how it moves.

In a window, a price's notional stays what it was last seen to be, and is 0 before it is first seen; only prices up to
the first snapshot's outermost level count. Nothing is filled row by row: each sighting of a price changes the window's
quantity by its notional less the one before, so a quantity is a running sum of changes, and a change's earlier value
is the same for all windows that hold both sightings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.joins import hops


def sightings(side: str, places: int) -> Column:
    """(side, price, n) of a row's levels, prices rounded; of levels at one price the last one."""
    price = F.transform(f"{side}_price", lambda p: F.round(p.cast("double"), places))
    levels = F.zip_with(price, f"{side}_size", lambda p, s: F.struct(F.lit(side).alias("side"), p.alias("price"), (p * s).alias("n")))
    return F.filter(levels, lambda x, i: x["price"].isNotNull() & ~F.exists(F.slice(levels, i + 2, F.size(levels)), lambda y: y["price"] == x["price"]))


def slope(y: str, x: str) -> Column:
    return F.when(F.var_pop(x) > 0, F.regr_slope(y, x))


def ratio_of_ends(c: str, order: Column) -> Column:
    first, last = F.min_by(c, order), F.max_by(c, order)
    return F.when(last + first != 0, F.try_divide(last - first, last + first)).otherwise(0.0)


def snapshot_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, length: int = 600, step: int = 10, places: int = 2) -> DataFrame:
    """Per key and window of `length` seconds that holds rows, one every `step` seconds from the first row on, both ends included:
    hop, time (of the last row, whole seconds), n_rows, slope_bid, slope_ask (of the quantity on milliseconds), change_bid,
    change_ask ((last - first) / (last + first)), variance_bid, variance_ask (mean over population deviation, 0 for a
    constant), slope_imbalance, mean_imbalance, n_bid_levels, n_ask_levels, breadth_ratio, slope_mid and drift_mid (of the mid
    of the two sides' prices weighted by notional).

    `df` has the four arrays of a book, and `at`, seconds as a number; windows begin before the last row. Slopes are null for a single row.
    """
    rows = df.select(*keys, *order, F.col(at).cast("double").alias("at"), *[F.col(f"{s}_{f}") for s in ("bid", "ask") for f in ("price", "size")])
    edge = lambda side: F.round(F.element_at(f"{side}_price", -1).cast("double"), places).alias(f"{side}_edge")
    seen = rows.select(*keys, *order, "at", edge("bid"), edge("ask"), F.explode(F.concat(sightings("bid", places), sightings("ask", places))).alias("o")).select(*keys, *order, "at", "bid_edge", "ask_edge", "o.*")
    by_price = Window.partitionBy(*keys, "side", "price").orderBy(*order)
    seen = seen.withColumns({"n0": F.lag("n").over(by_price), "at0": F.lag("at").over(by_price)})
    moves = seen.groupBy(*keys, *order, "at", "bid_edge", "ask_edge").agg(F.collect_list(F.struct("side", "price", "n", "n0", "at0")).alias("moves"))
    span = rows.groupBy(*keys).agg(F.min("at").alias("origin"), F.max("at").alias("until"))
    inside = hops(moves.join(span, list(keys)), "at", F.col("origin"), length, step).withColumn("begin", F.col("origin") + F.col("hop") * step).filter("begin < until")
    w = Window.partitionBy(*keys, "hop").orderBy(*order)
    inside = inside.withColumns({f"{s}_edge": F.first(f"{s}_edge").over(w) for s in ("bid", "ask")})

    def moved(side: str, what) -> Column:
        counts = lambda m: (m["side"] == side) & ((m["price"] <= F.col("ask_edge")) if side == "ask" else (m["price"] >= F.col("bid_edge")))
        return F.aggregate(F.filter("moves", counts), F.lit(0.0), lambda a, m: a + what(m, F.coalesce(m["at0"] >= F.col("begin"), F.lit(False))))

    out = {}
    for side in ("bid", "ask"):
        change = lambda m, again: m["n"] - F.when(again, m["n0"]).otherwise(0.0)
        out[side] = moved(side, change)
        out[f"{side}_value"] = moved(side, lambda m, again: change(m, again) * m["price"])
        out[f"{side}_new"] = moved(side, lambda m, again: F.when(again, 0.0).otherwise(1.0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select(*keys, *order, "hop", "at", *[e.alias(n) for n, e in out.items()])
    inside = inside.withColumns({n: F.round(F.sum(n).over(upto), 4) for n in out} | {"ms": 1000 * (F.col("at") - F.first("at").over(w))})
    both = F.col("bid") + F.col("ask")
    price = lambda side: F.try_divide(F.col(f"{side}_value"), F.nullif(F.col(side), F.lit(0.0)))
    inside = inside.withColumns({"imbalance": F.when(both != 0, F.try_divide(F.col("bid") - F.col("ask"), both)).otherwise(0.0), "mid": (price("bid") + price("ask")) / 2})
    place = F.struct(*order)
    inverse = lambda c: F.when(F.stddev_pop(c) > 1e-9, F.avg(c) / F.stddev_pop(c)).otherwise(0.0)
    return inside.groupBy(*keys, "hop").agg(
        F.floor(F.max("at")).alias("time"), F.count("*").alias("n_rows"), slope("bid", "ms").alias("slope_bid"), slope("ask", "ms").alias("slope_ask"),
        ratio_of_ends("bid", place).alias("change_bid"), ratio_of_ends("ask", place).alias("change_ask"), inverse("bid").alias("variance_bid"), inverse("ask").alias("variance_ask"),
        slope("imbalance", "ms").alias("slope_imbalance"), F.avg("imbalance").alias("mean_imbalance"), F.max("bid_new").cast("long").alias("n_bid_levels"), F.max("ask_new").cast("long").alias("n_ask_levels"),
        F.coalesce(F.try_divide(F.max("bid_new"), F.max("ask_new")), F.lit(0.0)).alias("breadth_ratio"), slope("mid", "ms").alias("slope_mid"), (F.max_by("mid", place) - F.min_by("mid", place)).alias("drift_mid"),
    )

"""Features of an order book: one row a snapshot, four arrays (bid_price, bid_size, ask_price, ask_size) from the best level on.

Static features need only their own row. Those that compare with earlier snapshots take the keys and an order with a
unique last column and share one window, so one shuffle and one sort serve them all. Before the first snapshot of a
key nothing has changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import arrays as A

EPS = 1e-10
LEVELS = 10
#: Least squares on the levels 1..10: the weights of the slope and of the square's coefficient.
SLOPE = [(k - 5.5) / 82.5 for k in range(1, LEVELS + 1)]
CURVE = [((k - 5.5) ** 2 - 8.25) / 528 for k in range(1, LEVELS + 1)]


def from_wide(df: DataFrame, levels: int = LEVELS, pattern: str = "{side}_{field}_{k}") -> DataFrame:
    """Gathers columns such as bid_price_1 .. ask_size_10 into the four arrays; other columns stay."""
    names = {f"{side}_{field}": [pattern.format(side=side, field=field, k=k) for k in range(1, levels + 1)] for side in ("bid", "ask") for field in ("price", "size")}
    wide = {c for cols in names.values() for c in cols}
    return df.select(*[c for c in df.columns if c not in wide], *[F.array(*[F.col(c).cast("double") for c in cols]).alias(n) for n, cols in names.items()])


def normalize(df: DataFrame) -> DataFrame:
    """Adds mid, spread (at least EPS), rel_spread, notionals per level and in all, prices in spreads from mid and shares of the notional."""
    notional = lambda side: F.zip_with(f"{side}_price", f"{side}_size", lambda p, s: p * s)
    df = df.withColumns({"mid": (F.col("bid_price")[0] + F.col("ask_price")[0]) / 2, "spread": F.greatest(F.col("ask_price")[0] - F.col("bid_price")[0], F.lit(EPS)), "bid_notional": notional("bid"), "ask_notional": notional("ask")})
    df = df.withColumns({"rel_spread": F.col("spread") / (F.col("mid") + EPS), "total_notional": A.total(F.col("bid_notional")) + A.total(F.col("ask_notional"))})
    out = {}
    for side in ("bid", "ask"):
        out[f"{side}_price_norm"] = F.transform(f"{side}_price", lambda p: (p - F.col("mid")) / (F.col("spread") + EPS))
        out[f"{side}_size_norm"] = F.transform(f"{side}_notional", lambda n: n / (F.col("total_notional") + EPS))
    return df.withColumns(out)


def imbalance(first: int, last: int) -> Column:
    """(bids - asks) / (bids + asks) of the notional on levels first..last."""
    b, a = (A.total(F.slice(f"{side}_notional", first, last - first + 1)) for side in ("bid", "ask"))
    return (b - a) / (b + a + EPS)


def static_features(df: DataFrame) -> DataFrame:
    """Adds imbalances at six depths, the two contrasts of depths, slopes, curvatures and centres of the book's sides."""
    out = {f"imbalance_L{k}": imbalance(1, k) for k in (1, 2, 3, 5, 7, 10)}
    df = df.withColumns(out).withColumns({"surface_vs_deep": F.col("imbalance_L1") - F.col("imbalance_L5"), "shallow_vs_full": F.col("imbalance_L3") - F.col("imbalance_L10")})
    out = {}
    for side in ("bid", "ask"):
        n = F.col(f"{side}_notional")
        scale = A.total(n) + EPS
        for name, weights in (("slope", SLOPE), ("curvature", CURVE)):
            out[f"{side}_{name}"] = F.when(A.total(n) > EPS, A.dot(n, A.literals(weights)) / scale).otherwise(0.0)
        out[f"{side}_gravity"] = A.dot(n, A.literals(range(1, LEVELS + 1))) / scale
    df = df.withColumns(out)
    return df.withColumns({"slope_asymmetry": F.col("bid_slope") - F.col("ask_slope"), "curvature_signal": F.col("bid_curvature") - F.col("ask_curvature"), "gravity_signal": F.col("ask_gravity") - F.col("bid_gravity")})


def sweep_price(side: str, target: Column) -> Column:
    """The average price of taking `target` of notional from a side, best level first; of all of it if there is less. Null for an empty side."""
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("shares"))

    def step(s, level):
        take = F.least(level["n"], target - s["filled"])
        return F.struct((s["filled"] + take).alias("filled"), (s["shares"] + F.coalesce(F.try_divide(take, level["p"]), F.lit(0.0))).alias("shares"))

    levels = F.zip_with(f"{side}_price", f"{side}_notional", lambda p, n: F.struct(p.alias("p"), n.alias("n")))
    return F.aggregate(levels, start, step, lambda s: F.try_divide(s["filled"], s["shares"]))


def impact(df: DataFrame, share: float = 0.1) -> DataFrame:
    """Adds what sweeping `share` of the snapshot's own notional costs on each side, relative to mid, and the difference."""
    target = share * F.col("total_notional")
    df = df.withColumns({"vwap_ask_impact": (sweep_price("ask", target) - F.col("mid")) / (F.col("mid") + EPS), "vwap_bid_impact": (F.col("mid") - sweep_price("bid", target)) / (F.col("mid") + EPS)})
    return df.withColumn("vwap_impact_asymmetry", F.col("vwap_ask_impact") - F.col("vwap_bid_impact"))


def _before(df: DataFrame, keys, order, columns) -> DataFrame:
    """Adds _columns: the values of the snapshot before, its own on the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"_{c}": F.coalesce(F.lag(c).over(w), F.col(c)) for c in columns})


def _drop(df: DataFrame, given: list[str]) -> DataFrame:
    """Without the columns that were added meanwhile to compute others; those given stay."""
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in given])


DEPTHS = (1, 3, 5, 10)


def dynamic_features(df: DataFrame, keys, order) -> DataFrame:
    """Adds flows, returns of mid, first and second differences of spread and imbalances, stability and flips of levels, migration and momentum of depth."""
    given = df.columns
    moving = ["spread", *[f"imbalance_L{k}" for k in DEPTHS]]
    df = _before(df, keys, order, ["mid", "total_notional", "bid_notional", "ask_notional", "bid_price", "ask_price", *moving])
    change = lambda c: F.col(c) - F.col(f"_{c}")
    flow = {side: A.total(A.difference(F.col(f"{side}_notional"), F.col(f"_{side}_notional"))) for side in ("bid", "ask")}
    same = {side: A.mean(F.zip_with(f"{side}_price", f"_{side}_price", lambda p, q: (p == q).cast("double"))) for side in ("bid", "ask")}
    shift = sum(A.mean(F.col(f"{side}_price")) - A.mean(F.col(f"_{side}_price")) for side in ("bid", "ask"))
    out = {
        "net_flow_bid": flow["bid"], "net_flow_ask": flow["ask"], "net_flow_signed": flow["bid"] - flow["ask"],
        "mid_return": change("mid") / (F.col("mid") + EPS), "mid_return_spread_normalized": change("mid") / (F.col("spread") + EPS),
        "level_stability_bid": same["bid"], "level_stability_ask": same["ask"], "level_stability": (same["bid"] + same["ask"]) / 2,
        "l1_bid_flip": (F.col("bid_price")[0] != F.col("_bid_price")[0]).cast("double"), "l1_ask_flip": (F.col("ask_price")[0] != F.col("_ask_price")[0]).cast("double"),
        "book_migration_speed": F.abs(shift) / (F.col("spread") + EPS), "depth_momentum": change("total_notional") / (F.col("total_notional") + EPS),
    }
    named = {"spread": ("spread_velocity", "spread_accel")} | {f"imbalance_L{k}": (f"imbalance_velocity_L{k}", f"imbalance_accel_L{k}") for k in DEPTHS}
    df = df.withColumns(out | {velocity: change(c) for c, (velocity, _) in named.items()})
    w = Window.partitionBy(*keys).orderBy(*order)
    return _drop(df.withColumns({accel: F.col(velocity) - F.coalesce(F.lag(velocity).over(w), F.col(velocity)) for velocity, accel in named.values()}), given)


def hidden_features(df: DataFrame, keys, order) -> DataFrame:
    """Adds divergence of near and deep book, iceberg shares, the product of the return with that five snapshots on, toxicity, entropy of the flow, likeness of the bid's halves and aggression at the best price."""
    given = df.columns
    df = _before(df, keys, order, ["mid", "bid_notional", "ask_notional", "bid_price", "ask_price", "bid_size", "ask_size"])
    w = Window.partitionBy(*keys).orderBy(*order)
    out, used, moved = {"book_divergence": imbalance(1, 3) - imbalance(4, LEVELS)}, {}, []
    for side, sign in (("bid", 1), ("ask", -1)):
        size, size0 = F.col(f"{side}_size"), F.col(f"_{side}_size")
        top = F.abs(size[0] - size0[0])
        deep = F.abs(A.total(F.slice(size, 2, LEVELS - 1)) - A.total(F.slice(size0, 2, LEVELS - 1)))
        out[f"iceberg_{side}"] = 1 - top / (deep + top + EPS)
        used[side] = F.greatest(A.total(F.col(f"_{side}_notional")) - A.total(F.col(f"{side}_notional")), F.lit(0.0))
        moved.append(A.magnitudes(A.difference(F.col(f"{side}_notional"), F.col(f"_{side}_notional"))))
        out[f"queue_aggression_{side}"] = F.greatest(sign * (F.col(f"{side}_price")[0] - F.col(f"_{side}_price")[0]), F.lit(0.0)) * size[0]
    out["toxicity"] = F.abs(used["bid"] - used["ask"]) / (used["bid"] + used["ask"] + EPS)
    out["book_self_similarity"] = A.correlation(F.slice("bid_notional", 1, 5), F.slice("bid_notional", 6, 5), EPS)
    df = df.withColumns(out | {"_r": (F.col("mid") - F.col("_mid")) / (F.col("spread") + EPS), "_moved": F.concat(*moved)})
    return _drop(df.withColumns({
        "iceberg_net": F.col("iceberg_bid") - F.col("iceberg_ask"), "queue_aggression_net": F.col("queue_aggression_bid") - F.col("queue_aggression_ask"),
        "flow_entropy": A.entropy(F.col("_moved"), EPS), "realized_spread_lead5": F.col("_r") * F.coalesce(F.lead("_r", 5).over(w), F.lit(0.0)),
    }), given)


def targets(df: DataFrame, keys, order, horizons=(10, 30, 100, 500, 1000)) -> DataFrame:
    """Adds per horizon N: ret_N, ret_spread_N, direction_N and vol_N, the population deviation of the N returns from the own row on; null on a key's last N rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    given = df.columns
    df = df.withColumn("_r", (F.col("mid") - F.coalesce(F.lag("mid").over(w), F.col("mid"))) / (F.col("mid") + EPS))
    for n in horizons:
        ahead = F.lead("mid", n).over(w)
        df = df.withColumns({f"ret_{n}": (ahead - F.col("mid")) / (F.col("mid") + EPS), f"ret_spread_{n}": (ahead - F.col("mid")) / (F.col("spread") + EPS)})
        df = df.withColumns({f"direction_{n}": F.signum(f"ret_{n}"), f"vol_{n}": F.when(F.col(f"ret_{n}").isNotNull(), F.stddev_pop("_r").over(w.rowsBetween(0, n - 1)))})
    return _drop(df, given)


def level_rows(df: DataFrame, keys, order) -> DataFrame:
    """One row a level and side: keys, order, side, level, price, notional."""
    sides = [F.struct(F.lit(side).alias("side"), F.arrays_zip(F.col(f"{side}_price").alias("price"), F.col(f"{side}_notional").alias("notional")).alias("levels")) for side in ("bid", "ask")]
    rows = df.select(*keys, *order, F.explode(F.array(*sides)).alias("s")).select(*keys, *order, "s.side", F.posexplode("s.levels").alias("level", "l"))
    return rows.select(*keys, *order, "side", (F.col("level") + 1).alias("level"), F.col("l.price").alias("price"), F.col("l.notional").alias("notional"))

"""Queries of the order-book operators. The book is derived from `embeddings`: `label` is the symbol, `vec_id` the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scalars import rounded_half
from marlstone.operators import book as B

KEYS, ORDER = ["symbol"], ["seq"]


def rounded(df, *keys, places: int = 6):
    """The key columns as they are, the others rounded; minus zero becomes zero."""
    return df.select(*keys, *[(rounded_half(F.col(c).cast("double"), places) + F.lit(0.0)).alias(c) for c in df.columns if c not in keys])


def snapshots(spark, sf_dir):
    part = lambda begin: F.transform(F.slice("embedding", begin, 10), lambda x: F.abs(x.cast("double")))
    price = lambda begin, sign: F.transform(part(begin), lambda x, i: 100 + sign * (0.01 * (i + 1) + 0.001 * x))
    size = lambda begin: F.transform(part(begin), lambda x: (1 + F.floor(1000 * x)).cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return B.normalize(rows.select(F.col("label").alias("symbol"), F.col("vec_id").alias("seq"), price(1, -1).alias("bid_price"), size(21).alias("bid_size"), price(11, 1).alias("ask_price"), size(31).alias("ask_size")))


STATIC = [*[f"imbalance_L{k}" for k in (1, 2, 3, 5, 7, 10)], "surface_vs_deep", "shallow_vs_full", *[f"{s}_{n}" for n in ("slope", "curvature", "gravity") for s in ("bid", "ask")], "slope_asymmetry", "curvature_signal", "gravity_signal"]
DYNAMIC = ["net_flow_bid", "net_flow_ask", "net_flow_signed", "mid_return", "mid_return_spread_normalized", "spread_velocity", "spread_accel", *[f"imbalance_{n}_L{k}" for n in ("velocity", "accel") for k in B.DEPTHS], "level_stability_bid", "level_stability_ask", "level_stability", "l1_bid_flip", "l1_ask_flip", "book_migration_speed", "depth_momentum"]
HIDDEN = ["book_divergence", "iceberg_bid", "iceberg_ask", "iceberg_net", "realized_spread_lead5", "toxicity", "flow_entropy", "book_self_similarity", "queue_aggression_bid", "queue_aggression_ask", "queue_aggression_net"]
HORIZONS = (5, 10)
TARGETS = [f"{n}_{h}" for h in HORIZONS for n in ("ret", "ret_spread", "direction", "vol")]


def book_normalize(spark, sf_dir):
    flat = snapshots(spark, sf_dir).select("symbol", "seq", "mid", "spread", "rel_spread", "total_notional", F.col("bid_price_norm")[9].alias("bid_price_norm_10"), F.col("ask_size_norm")[4].alias("ask_size_norm_5"))
    return rounded(flat, "symbol", "seq")


def book_static(spark, sf_dir):
    return rounded(B.static_features(snapshots(spark, sf_dir)).select("symbol", "seq", *STATIC), "symbol", "seq")


def book_dynamic(spark, sf_dir):
    return rounded(B.dynamic_features(B.static_features(snapshots(spark, sf_dir)), KEYS, ORDER).select("symbol", "seq", *DYNAMIC), "symbol", "seq")


def book_hidden(spark, sf_dir):
    return rounded(B.hidden_features(snapshots(spark, sf_dir), KEYS, ORDER).select("symbol", "seq", *HIDDEN), "symbol", "seq")


def vwap_impact(spark, sf_dir):
    return rounded(B.impact(snapshots(spark, sf_dir)).select("symbol", "seq", "vwap_ask_impact", "vwap_bid_impact", "vwap_impact_asymmetry"), "symbol", "seq", places=8)


def book_targets(spark, sf_dir):
    return rounded(B.targets(snapshots(spark, sf_dir), KEYS, ORDER, HORIZONS).select("symbol", "seq", *TARGETS), "symbol", "seq")


def book_levels(spark, sf_dir):
    return rounded(B.level_rows(snapshots(spark, sf_dir), KEYS, ORDER), "symbol", "seq", "side", "level")


QUERIES = {f.__name__: f for f in (book_normalize, book_static, book_dynamic, book_hidden, vwap_impact, book_targets, book_levels)}

EPS = "1e-10"


def _round(names, places=6):
    return ", ".join(f"round({n}, {places}) + 0e0 AS {n}" for n in names)


def _part(begin, body):
    return f"list_transform(range(1, 11), lambda k: {body.replace('X', f'abs(CAST(embedding[k + {begin - 1}] AS DOUBLE))')})"


BOOK = f"""
WITH b0 AS (
  SELECT label AS symbol, vec_id AS seq, {_part(1, '100e0 - (1e-2 * k + 1e-3 * X)')} AS bp, {_part(21, '1e0 + floor(1000 * X)')} AS bs,
    {_part(11, '100e0 + (1e-2 * k + 1e-3 * X)')} AS ap, {_part(31, '1e0 + floor(1000 * X)')} AS asz FROM embeddings),
b1 AS (
  SELECT *, (bp[1] + ap[1]) / 2 AS mid, greatest(ap[1] - bp[1], {EPS}) AS spread,
    list_transform(range(1, 11), lambda k: bp[k] * bs[k]) AS bn, list_transform(range(1, 11), lambda k: ap[k] * asz[k]) AS an FROM b0),
b AS (SELECT *, spread / (mid + {EPS}) AS rel_spread, list_sum(bn) + list_sum(an) AS total_notional FROM b1)"""


def _imb(first, last):
    b, a = (f"list_sum({s}[{first}:{last}])" for s in ("bn", "an"))
    return f"(({b} - {a}) / ({b} + {a} + {EPS}))"


def _dot(side, weights):
    return "(" + " + ".join(f"{side}[{k}] * ({w!r}e0)" for k, w in enumerate(weights, 1)) + f") / (list_sum({side}) + {EPS})"


_stat = {f"imbalance_L{k}": _imb(1, k) for k in (1, 2, 3, 5, 7, 10)} | {"surface_vs_deep": f"{_imb(1, 1)} - {_imb(1, 5)}", "shallow_vs_full": f"{_imb(1, 3)} - {_imb(1, 10)}"}
for _name, _weights, _sign in (("slope", B.SLOPE, 1), ("curvature", B.CURVE, 1), ("gravity", list(map(float, range(1, 11))), -1)):
    _b, _a = _dot("bn", [round(w, 17) for w in _weights]), _dot("an", [round(w, 17) for w in _weights])
    _stat |= {f"bid_{_name}": _b, f"ask_{_name}": _a, {"slope": "slope_asymmetry", "curvature": "curvature_signal", "gravity": "gravity_signal"}[_name]: f"({_b}) - ({_a})" if _sign > 0 else f"({_a}) - ({_b})"}
_W = "OVER (PARTITION BY symbol ORDER BY seq)"
_pre = ", ".join(f"coalesce(lag({c}) {_W}, {c}) AS {c}0" for c in ("mid", "spread", "total_notional", "bn", "an", "bp", "ap", "bs", "asz"))
PREV = f"{BOOK},\np AS (SELECT *, {_pre} FROM b)"
_mean = lambda s: f"list_sum({s}) / 10"
_same = lambda s: f"(list_sum(list_transform(range(1, 11), lambda k: CASE WHEN {s}[k] = {s}0[k] THEN 1e0 ELSE 0e0 END)) / 10)"
_dyn = {
    "net_flow_bid": "list_sum(bn) - list_sum(bn0)", "net_flow_ask": "list_sum(an) - list_sum(an0)", "net_flow_signed": "(list_sum(bn) - list_sum(bn0)) - (list_sum(an) - list_sum(an0))",
    "mid_return": f"(mid - mid0) / (mid + {EPS})", "mid_return_spread_normalized": f"(mid - mid0) / (spread + {EPS})",
    "level_stability_bid": _same("bp"), "level_stability_ask": _same("ap"), "level_stability": f"({_same('bp')} + {_same('ap')}) / 2",
    "l1_bid_flip": "CASE WHEN bp[1] != bp0[1] THEN 1e0 ELSE 0e0 END", "l1_ask_flip": "CASE WHEN ap[1] != ap0[1] THEN 1e0 ELSE 0e0 END",
    "book_migration_speed": f"abs({_mean('bp')} - {_mean('bp0')} + {_mean('ap')} - {_mean('ap0')}) / (spread + {EPS})", "depth_momentum": f"(total_notional - total_notional0) / (total_notional + {EPS})",
    "spread_velocity": "spread - spread0", **{f"imbalance_velocity_L{k}": f"{_imb(1, k)} - {_imb(1, k).replace('bn[', 'bn0[').replace('an[', 'an0[')}" for k in B.DEPTHS},
}
_acc = {"spread_accel": "spread_velocity", **{f"imbalance_accel_L{k}": f"imbalance_velocity_L{k}" for k in B.DEPTHS}}
_as = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())
_ice = lambda s: f"1 - abs({s}[1] - {s}0[1]) / (abs(list_sum({s}[2:10]) - list_sum({s}0[2:10])) + abs({s}[1] - {s}0[1]) + {EPS})"
_moved = "list_concat(list_transform(range(1, 11), lambda k: abs(bn[k] - bn0[k])), list_transform(range(1, 11), lambda k: abs(an[k] - an0[k])))"

SQL = {
    "book_normalize": f"{BOOK} SELECT symbol, seq, {_round(['mid', 'spread', 'rel_spread', 'total_notional'])}, round((bp[10] - mid) / (spread + {EPS}), 6) AS bid_price_norm_10, round(an[5] / (total_notional + {EPS}), 6) AS ask_size_norm_5 FROM b",
    "book_static": f"{BOOK} SELECT symbol, seq, {_round(STATIC)} FROM (SELECT symbol, seq, {_as(_stat)} FROM b)",
    "book_dynamic": f"{PREV} SELECT symbol, seq, {_round(DYNAMIC)} FROM (SELECT *, {', '.join(f'{v} - coalesce(lag({v}) {_W}, {v}) AS {n}' for n, v in _acc.items())} FROM (SELECT symbol, seq, {_as(_dyn)} FROM p))",
    "book_hidden": f"""{PREV},
q AS (SELECT *, {_moved} AS moved, greatest(list_sum(bn0) - list_sum(bn), 0e0) AS ub, greatest(list_sum(an0) - list_sum(an), 0e0) AS ua, (mid - mid0) / (spread + {EPS}) AS r,
  {_ice('bs')} AS iceberg_bid, {_ice('asz')} AS iceberg_ask, greatest(bp[1] - bp0[1], 0e0) * bs[1] AS queue_aggression_bid, greatest(ap0[1] - ap[1], 0e0) * asz[1] AS queue_aggression_ask FROM p),
pairs AS (SELECT symbol, seq, corr(bn[k], bn[k + 5]) AS c FROM b, unnest(range(1, 6)) AS t(k) GROUP BY ALL)
SELECT symbol, seq, {_round(HIDDEN)} FROM (
  SELECT q.*, {_imb(1, 3)} - {_imb(4, 10)} AS book_divergence, iceberg_bid - iceberg_ask AS iceberg_net, r * coalesce(lead(r, 5) {_W}, 0e0) AS realized_spread_lead5,
    abs(ub - ua) / (ub + ua + {EPS}) AS toxicity, coalesce(c, 0e0) AS book_self_similarity, queue_aggression_bid - queue_aggression_ask AS queue_aggression_net,
    CASE WHEN list_sum(moved) > {EPS} THEN -list_sum(list_transform(moved, lambda m: (m / list_sum(moved) + {EPS}) / (1 + 20 * {EPS}) * ln((m / list_sum(moved) + {EPS}) / (1 + 20 * {EPS})))) ELSE 0e0 END AS flow_entropy
  FROM q JOIN pairs USING (symbol, seq))""",
    "vwap_impact": f"""{BOOK},
l AS (SELECT symbol, seq, mid, 1e-1 * total_notional AS target, side, k, CASE side WHEN 'bid' THEN bp[k] ELSE ap[k] END AS p, CASE side WHEN 'bid' THEN bn[k] ELSE an[k] END AS n
  FROM b, unnest(range(1, 11)) AS t(k), (VALUES ('bid'), ('ask')) AS s(side)),
t AS (SELECT *, greatest(0e0, least(n, target - (sum(n) OVER (PARTITION BY symbol, seq, side ORDER BY k) - n))) AS took FROM l),
v AS (SELECT symbol, seq, mid, sum(took) FILTER (side = 'ask') / sum(took / p) FILTER (side = 'ask') AS va, sum(took) FILTER (side = 'bid') / sum(took / p) FILTER (side = 'bid') AS vb FROM t GROUP BY ALL)
SELECT symbol, seq, {_round(['vwap_ask_impact', 'vwap_bid_impact', 'vwap_impact_asymmetry'], 8)} FROM (
  SELECT *, vwap_ask_impact - vwap_bid_impact AS vwap_impact_asymmetry FROM (SELECT *, (va - mid) / (mid + {EPS}) AS vwap_ask_impact, (mid - vb) / (mid + {EPS}) AS vwap_bid_impact FROM v))""",
    "book_targets": f"""{BOOK},
r AS (SELECT *, (mid - coalesce(lag(mid) {_W}, mid)) / (mid + {EPS}) AS r FROM b)
SELECT symbol, seq, {_round(TARGETS)} FROM (SELECT symbol, seq, {', '.join(
        f"(lead(mid, {h}) {_W} - mid) / (mid + {EPS}) AS ret_{h}, (lead(mid, {h}) {_W} - mid) / (spread + {EPS}) AS ret_spread_{h}, sign((lead(mid, {h}) {_W} - mid) / (mid + {EPS})) AS direction_{h}, CASE WHEN lead(mid, {h}) {_W} IS NOT NULL THEN stddev_pop(r) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) END AS vol_{h}"
        for h in HORIZONS)} FROM r)""",
    "book_levels": f"""{BOOK} SELECT symbol, seq, side, CAST(k AS INTEGER) AS level, round(CASE side WHEN 'bid' THEN bp[k] ELSE ap[k] END, 6) AS price, round(CASE side WHEN 'bid' THEN bn[k] ELSE an[k] END, 6) AS notional
FROM b, unnest(range(1, 11)) AS t(k), (VALUES ('bid'), ('ask')) AS s(side)""",
}

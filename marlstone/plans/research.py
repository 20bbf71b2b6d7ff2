"""Queries of snapshot windows, the feature pyramid, labels, order flow and the small helpers of a research loop, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import alpha as A
from marlstone.operators import book as B
from marlstone.operators import flow as O
from marlstone.operators import labels as L
from marlstone.operators import portfolio as P
from marlstone.operators import pyramid as Y
from marlstone.operators import series as S
from marlstone.operators import snapshots as N
from marlstone.operators import windows as W
from marlstone.plans import book as book_plans
from marlstone.plans import market
from marlstone.plans import models as model_plans
from marlstone.plans.book import BOOK, DYNAMIC, HIDDEN, HORIZONS, STATIC, TARGETS, rounded, snapshots
from marlstone.plans.queries import KEYS, ORDER, events

ID = "event_id"
SYMBOL, SEQ = ["symbol"], ["seq"]
PYRAMID = ("imbalance_L1", "imbalance_L5", "rel_spread", "bid_gravity")
#: Seconds between two numbers of a snapshot.
PACE = 7


def snapshot_features(spark, sf_dir):
    rows = snapshots(spark, sf_dir).withColumn("at", F.col("seq") * PACE)
    return rounded(N.snapshot_features(rows, SYMBOL, SEQ, "at"), "symbol", "hop", "time", "n_rows", "n_bid_levels", "n_ask_levels", places=8)


def rolling_pyramid(spark, sf_dir):
    rows = B.static_features(snapshots(spark, sf_dir))
    return rounded(Y.rolling_pyramid(rows, PYRAMID, SYMBOL, SEQ), "symbol", "seq", "feature", "window", places=5)


def surprise_scores(spark, sf_dir):
    return rounded(Y.surprise(snapshots(spark, sf_dir), SYMBOL, SEQ, 50.0, 10), "symbol", "seq", places=2)


SWEEPS = ["vwap_ask_impact", "vwap_bid_impact", "vwap_impact_asymmetry"]


def feature_matrix(spark, sf_dir):
    """All features but the principal components, which SQL cannot express."""
    found = Y.feature_matrix(snapshots(spark, sf_dir), SYMBOL, SEQ, HORIZONS, quiet=10, components=0)
    places = dict.fromkeys(SWEEPS, 8) | {"surprise_score": 2, "mm_inventory_pressure": 4}
    return found.select("symbol", "seq", *[(F.round(c, places.get(c, 6)) + F.lit(0.0)).alias(c) for c in ("spread", "rel_spread", *SWEEPS, *STATIC, *DYNAMIC, *HIDDEN, *TARGETS, "surprise_score", "mm_inventory_pressure")])


def full_feature_matrix(spark, sf_dir):
    """Every column, with eight components over 40 snapshots and the rolling moments of two windows."""
    return Y.feature_matrix(snapshots(spark, sf_dir), SYMBOL, SEQ, HORIZONS, rows=40, windows=(5, 10))


def _informative(spark, sf_dir):
    return Y.feature_matrix(snapshots(spark, sf_dir), SYMBOL, SEQ, HORIZONS, components=0).select(*STATIC, *DYNAMIC, "ret_spread_5").withColumns({c: F.round(c, 9) for c in [*STATIC, *DYNAMIC, "ret_spread_5"]})


def information_report(spark, sf_dir):
    """Sorted by falling size of the rank correlation."""
    return Y.information_report(_informative(spark, sf_dir), [*STATIC, *DYNAMIC], "ret_spread_5")


def clean_feature_set(spark, sf_dir):
    """The kept features, one column each."""
    rows = _informative(spark, sf_dir)
    return rows.select(*Y.clean_features(rows, [*STATIC, *DYNAMIC], "ret_spread_5"))


def triple_barriers(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("sigma", F.when(F.col(ID) % 5 != 0, F.abs(F.col("value") - 250) / 1000))
    return rounded(L.triple_barrier(rows, "value", "sigma", KEYS, ORDER, horizon=45, zeros=True).select(ID, "label", "t_hit", "ret"), ID, "label", "t_hit")


def pre_averaged_variance(spark, sf_dir):
    return rounded(L.pre_averaged_variance(events(spark, sf_dir), "value", KEYS, ORDER, 5, 30, zeros=True).select(ID, "pav_rv"), ID)


def wilder_index(spark, sf_dir):
    return rounded(S.wilder_index(events(spark, sf_dir), "value", KEYS, ORDER).select(ID, "rsi"), ID, places=4)


def _trades(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return rows.withColumns({"sign": F.signum(F.col("value") - 250), "qty": F.abs(F.col("value") - 250)})


def flow_on_grid(spark, sf_dir):
    rows = _trades(spark, sf_dir).filter("event_type = 'click'").withColumn("amount", O.concave(F.col("sign"), F.col("qty")))
    return rounded(O.flow_on_grid(rows, "at", "amount", KEYS, ID, 21600.0, (7200.0, 86400.0), (0.75, 0.25)), "user_id", "grid")


def flow_engine(spark, sf_dir):
    """Clicks as trades, purchases as quotes, all other events as depths; an hour of the engine is a day here, as users have few events."""
    rows = _trades(spark, sf_dir)
    quotes = rows.filter("event_type = 'purchase'").select("user_id", "at", ID, (F.col("value") - 0.01).alias("bid"), (F.col("value") + 0.01).alias("ask"))
    depth = rows.filter("event_type NOT IN ('click', 'purchase')").select("user_id", "at", ID, F.col("value").alias("bid_sz"), (F.col("value") + 100).alias("ask_sz"))
    trades = rows.filter("event_type = 'click'").select("user_id", "at", ID, F.col("value").alias("price"), "qty", F.when(F.col(ID) % 2 == 0, F.col("sign").cast("int")).alias("aggressor"))
    return rounded(O.flow_engine(trades, quotes, depth, KEYS, "at", ID, step=3600.0, horizon=21600.0, eps=180.0, shortest=360.0, longest=2160000.0), "user_id", "n_trades", "obs_count", places=4)


def detected_metaorders(spark, sf_dir):
    rows = _trades(spark, sf_dir).withColumn("at", F.col("at") / 3600)
    return rounded(O.detect_metaorders(rows, "at", "qty", "sign", ["event_type"], ID, 0.25), "event_type", "sign", "n_child", places=4)


def mapped_metaorders(spark, sf_dir):
    return rounded(O.mapped_metaorders(_trades(spark, sf_dir), "at", "qty", "sign", ["event_type"], ["at", ID], ID), "event_type", "sign", "n_child", places=4)


def split_by_time(spark, sf_dir):
    return L.split_by_time(events(spark, sf_dir), KEYS, ORDER, 0.7).select(ID, "role")


def category_codes(spark, sf_dir):
    return L.category_codes(events(spark, sf_dir), "event_type").select(ID, "code")


def sample_scores(spark, sf_dir):
    return rounded(L.sample_scores(events(spark, sf_dir), "value", ["user_id", "event_type"]).select(ID, "z"), ID)


def strided_windows(spark, sf_dir):
    found = L.strided_windows(events(spark, sf_dir), "value", KEYS, ORDER, 8, 4, 3, 500.0)
    return rounded(found.select("user_id", "begin", F.col("x")[0].alias("x_first"), F.col("x")[7].alias("x_last"), F.col("y")[2].alias("y_last"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("x_sum")), "user_id", "begin")


def type_masks(spark, sf_dir):
    found = L.type_masks(market.feature_types(spark, sf_dir))
    return found.select("feature", F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"))


def row_batches(spark, sf_dir):
    rows = L.batches(events(spark, sf_dir), KEYS, ORDER, 16)
    return rows.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def largest_elements(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    top = L.top_per_row(F.transform("embedding", lambda x: x.cast("double")), 3)
    return rounded(rows.select("vec_id", *[top[i].alias(f"top_{i + 1}") for i in range(3)]), "vec_id")


def shared_keys(spark, sf_dir):
    """Users with clicks and purchases."""
    rows = events(spark, sf_dir)
    return rows.filter("event_type = 'click'").select("user_id").intersect(rows.filter("event_type = 'purchase'").select("user_id"))


def model_samples(spark, sf_dir):
    """Lengths that fit users of some 66 events; the operator's defaults are for bars of ten seconds."""
    short = {"span": 20, "average": 4, "rows": 24, "blocks": 4, "block_rows": 6, "lags": 5, "path": 20, "horizon": 10, "share": 0.01}
    return rounded(A.model_samples(events(spark, sf_dir), "value", KEYS, ORDER, **short).drop("user_id", "ts"), ID, "label")


def out_of_fold(spark, sf_dir):
    rows = W.returns(S.rolling(events(spark, sf_dir), "value", KEYS, ORDER, 10, 5), "value", KEYS, ORDER)
    rows = L.triple_barrier(rows.withColumn("sigma", F.col("sd") / F.col("mean")), "value", "sigma", KEYS, ORDER, 0.5, 0.5, 10)
    return A.out_of_fold(rows, ["diff", "logret", "zscore"], "label", KEYS, ORDER, 3, 10).select(ID, "fold", "label", F.round("p_up", 3).alias("p_up"))


def padded_bars(spark, sf_dir):
    return S.padded(S.ohlc(events(spark, sf_dir), "value", KEYS, "ts", ID, "hour"), KEYS, "1 hour")


def covariance_matrix(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(P.covariances(rows, rows.columns), "a", "b", places=3)


def weighted_moments(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    return rounded(P.weighted_moments(rows, "l_discount", "l_quantity", ["l_returnflag", "l_linestatus"]), "l_returnflag", "l_linestatus")


def restored_values(spark, sf_dir):
    rows = W.standardized(events(spark, sf_dir), "value", ["event_type"])
    return rounded(W.unscaled(rows, "value", "unit", ["event_type"]).select(ID, "restored"), ID)


def wavelet_clusters(spark, sf_dir):
    return A.wavelet_clusters(events(spark, sf_dir), "value", KEYS, ORDER, 32, 4, 4).select(ID, "cluster")


def forecast_strategy(spark, sf_dir):
    rows = W.returns(events(spark, sf_dir), "value", KEYS, ORDER)
    rows = L.split_by_time(rows.withColumns({"guess": F.lag("diff").over(W.ordered(KEYS, ORDER)) / -2}), KEYS, ORDER, 0.7).filter("role = 'test'")
    return rounded(P.forecast_strategy(rows, "guess", "diff", ["event_type"]), "event_type", "n", places=4)


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_features, rolling_pyramid, surprise_scores, feature_matrix, full_feature_matrix, information_report, clean_feature_set, triple_barriers, pre_averaged_variance, wilder_index, flow_on_grid, flow_engine,
        detected_metaorders, mapped_metaorders, split_by_time, category_codes, sample_scores, strided_windows, type_masks, row_batches, largest_elements, shared_keys, forecast_strategy, model_samples, out_of_fold, wavelet_clusters, padded_bars, covariance_matrix, weighted_moments, restored_values,
    )
}

BY = "PARTITION BY user_id ORDER BY ts, event_id"
_SYM = "PARTITION BY symbol ORDER BY seq"
_EPS = "1e-10"


def _side(side, price, size, op):
    """Sightings within a window, the quantity and value at each of its rows, and the prices seen so far."""
    return f"""
o_{side} AS (SELECT symbol, seq, sec, price, arg_max(n, k) AS n FROM (SELECT symbol, seq, sec, k, round({price}[k], 2) AS price, round({price}[k], 2) * {size}[k] AS n FROM b, unnest(range(1, 11)) AS t(k)) GROUP BY ALL),
i_{side} AS (SELECT w.symbol, w.hop, o.seq, price, n FROM w JOIN o_{side} o ON o.symbol = w.symbol AND o.seq = w.seq JOIN e ON e.symbol = w.symbol AND e.hop = w.hop AND price {op} e.{side}_edge),
l_{side} AS (SELECT w.symbol, w.hop, w.seq, i.price, arg_max(i.n, i.seq) AS n FROM w JOIN i_{side} i ON i.symbol = w.symbol AND i.hop = w.hop AND i.seq <= w.seq GROUP BY ALL),
q_{side} AS (SELECT symbol, hop, seq, round(sum(n), 4) AS {side}, round(sum(n * price), 4) AS {side}_value, count(*) AS {side}_new FROM l_{side} GROUP BY ALL)"""


def _slope(y):
    return f"CASE WHEN count(*) > 1 THEN round(regr_slope({y}, ms), 8) + 0e0 END"


_RECENT = "pow(49e0 / 51, i.r - j.r)"

SQL = {
    "snapshot_features": f"""{BOOK.replace('SELECT *, spread / (mid', f'SELECT *, seq * {PACE} AS sec, spread / (mid')},
span AS (SELECT symbol, min(sec) AS origin, max(sec) AS until FROM b GROUP BY 1),
w0 AS (SELECT b.symbol, seq, sec, origin, until, round(bp[10], 2) AS bid_edge, round(ap[10], 2) AS ask_edge, unnest(range(CAST(greatest(ceil((sec - origin - 600) / 10e0), 0) AS BIGINT), CAST(floor((sec - origin) / 10e0) AS BIGINT) + 1)) AS hop FROM b JOIN span USING (symbol)),
w AS (SELECT * FROM w0 WHERE origin + hop * 10 < until),
e AS (SELECT symbol, hop, arg_min(bid_edge, seq) AS bid_edge, arg_min(ask_edge, seq) AS ask_edge, min(sec) AS first_at FROM w GROUP BY ALL),{_side('bid', 'bp', 'bs', '>=')},{_side('ask', 'ap', 'asz', '<=')},
r0 AS (
  SELECT w.symbol, w.hop, w.seq, w.sec, 1000e0 * (w.sec - first_at) AS ms, coalesce(bid, 0e0) AS bid, coalesce(ask, 0e0) AS ask, bid_value, ask_value, coalesce(bid_new, 0) AS bid_new, coalesce(ask_new, 0) AS ask_new
  FROM w JOIN e USING (symbol, hop) LEFT JOIN q_bid USING (symbol, hop, seq) LEFT JOIN q_ask USING (symbol, hop, seq)),
r AS (SELECT *, CASE WHEN bid + ask != 0 THEN (bid - ask) / (bid + ask) ELSE 0e0 END AS imbalance, (bid_value / nullif(bid, 0) + ask_value / nullif(ask, 0)) / 2 AS mid FROM r0)
SELECT symbol, hop, CAST(floor(max(sec)) AS BIGINT) AS time, count(*) AS n_rows, {_slope('bid')} AS slope_bid, {_slope('ask')} AS slope_ask,
  {', '.join(f"round(CASE WHEN arg_max({s}, seq) + arg_min({s}, seq) != 0 THEN (arg_max({s}, seq) - arg_min({s}, seq)) / (arg_max({s}, seq) + arg_min({s}, seq)) ELSE 0e0 END, 8) + 0e0 AS change_{s}" for s in ('bid', 'ask'))},
  {', '.join(f"round(CASE WHEN stddev_pop({s}) > 1e-9 THEN avg({s}) / stddev_pop({s}) ELSE 0e0 END, 8) AS variance_{s}" for s in ('bid', 'ask'))},
  {_slope('imbalance')} AS slope_imbalance, round(avg(imbalance), 8) + 0e0 AS mean_imbalance, max(bid_new) AS n_bid_levels, max(ask_new) AS n_ask_levels,
  round(coalesce(max(bid_new) * 1e0 / nullif(max(ask_new), 0), 0e0), 8) AS breadth_ratio, {_slope('mid')} AS slope_mid, round(arg_max(mid, seq) - arg_min(mid, seq), 8) + 0e0 AS drift_mid
FROM r GROUP BY symbol, hop""",
    "triple_barriers": f"""
WITH s AS (SELECT *, row_number() OVER ({BY}) - 1 AS i, last_value(CASE WHEN event_id % 5 != 0 THEN abs(value - 250) / 1000 END IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS sigma FROM events),
t AS (SELECT a.user_id, a.i, min(b.i) FILTER (b.value >= a.value * (1 + 2 * a.sigma)) AS up, min(b.i) FILTER (b.value <= a.value * (1 - 15e-1 * a.sigma)) AS down, max(b.i) AS last FROM s a JOIN s b ON b.user_id = a.user_id AND b.i > a.i AND b.i <= a.i + 45 GROUP BY ALL),
h AS (SELECT user_id, i, CASE WHEN up IS NOT NULL AND (down IS NULL OR up < down OR up = down AND up = i + 1) THEN 1 WHEN down IS NOT NULL THEN -1 ELSE 0 END AS label, up, down, last FROM t),
g AS (SELECT user_id, i, label, CASE label WHEN 1 THEN up WHEN -1 THEN down ELSE last END AS t_hit FROM h)
SELECT s.event_id, CAST(coalesce(label, 0) AS INTEGER) AS label, CAST(t_hit AS INTEGER) AS t_hit, round(b.value / s.value - 1, 6) + 0e0 AS ret
FROM s LEFT JOIN g USING (user_id, i) LEFT JOIN s b ON b.user_id = s.user_id AND b.i = t_hit""",
    "pre_averaged_variance": f"""
WITH p AS (SELECT *, ln(value) AS p, row_number() OVER ({BY}) - 1 AS i FROM events),
q AS (SELECT *, {' + '.join(f'({k / 5 - 0.5!r}e0) * (lag(p, {4 - k}) OVER ({BY}) - lag(p, {5 - k}) OVER ({BY}))' for k in range(1, 5))} AS g FROM p),
r AS (SELECT event_id, user_id, ts, CASE WHEN i >= 30 THEN ({' + '.join(f'pow(lag(g, {5 * j}) OVER ({BY}), 2)' for j in range(1, 6))}) / 5 END AS v FROM q)
SELECT event_id, round(last_value(v IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), 6) AS pav_rv FROM r""",
    "wilder_index": f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, coalesce(value - lag(value) OVER ({BY}), 0e0) AS d, row_number() OVER ({BY}) AS i FROM events),
m AS (
  SELECT event_id, user_id, i, greatest(d, 0e0) AS g, greatest(-d, 0e0) AS l FROM e WHERE i = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.i, m.g + (greatest(e.d, 0e0) - m.g) / 14, m.l + (greatest(-e.d, 0e0) - m.l) / 14 FROM m JOIN e ON e.user_id = m.user_id AND e.i = m.i + 1)
SELECT event_id, round(CASE WHEN g + l > 0 THEN 100 * g / (g + l) END, 4) + 0e0 AS rsi FROM m""",
    "flow_on_grid": """
WITH t AS (SELECT user_id, epoch_us(ts) / 1e6 AS sec, sign(value - 250) * sqrt(abs(value - 250)) AS q FROM events WHERE event_type = 'click'),
g AS (SELECT user_id, unnest(range(CAST(floor(min(sec) / 21600) AS BIGINT), CAST(ceil(max(sec) / 21600) AS BIGINT) + 1)) * 216e2 AS grid FROM t GROUP BY 1)
SELECT g.user_id, grid, round(coalesce(sum(q * (75e-2 * exp((sec - grid) / 72e2) + 25e-2 * exp((sec - grid) / 864e2))), 0e0), 6) + 0e0 AS flow FROM g LEFT JOIN t ON t.user_id = g.user_id AND sec <= grid GROUP BY ALL""",
    "split_by_time": f"SELECT event_id, CASE WHEN row_number() OVER ({BY}) <= floor(7e-1 * count(*) OVER (PARTITION BY user_id)) THEN 'train' ELSE 'test' END AS role FROM events",
    "category_codes": "SELECT event_id, CAST(coalesce(dense_rank() OVER (ORDER BY event_type) - 1, -1) AS INTEGER) AS code FROM events",
    "sample_scores": "SELECT event_id, round((value - avg(value) OVER w) / greatest(coalesce(stddev_samp(value) OVER w, 0e0), 1e-6), 6) + 0e0 AS z FROM events WINDOW w AS (PARTITION BY user_id, event_type)",
    "strided_windows": f"""
WITH v AS (SELECT user_id, ts, event_id, greatest(-1e0, least(1e0, value / 500)) AS v FROM events),
f AS (SELECT user_id, row_number() OVER ({BY}) - 1 AS begin, v, lead(v, 7) OVER ({BY}) AS x7, lead(v, 10) OVER ({BY}) AS y2, sum(v) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s FROM v)
SELECT user_id, CAST(begin AS INTEGER) AS begin, round(v, 6) AS x_first, round(x7, 6) AS x_last, round(y2, 6) AS y_last, round(s, 6) AS x_sum FROM f WHERE begin % 4 = 0 AND y2 IS NOT NULL""",
    "row_batches": f"SELECT user_id, CAST(b AS BIGINT) AS batch, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT user_id, value, (row_number() OVER ({BY}) - 1) // 16 AS b FROM events) GROUP BY ALL",
    "largest_elements": "SELECT vec_id, round(x[1], 6) + 0e0 AS top_1, round(x[2], 6) + 0e0 AS top_2, round(x[3], 6) + 0e0 AS top_3 FROM (SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x FROM embeddings)",
    "shared_keys": "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'",
    "forecast_strategy": f"""
WITH r AS (SELECT *, value - lag(value) OVER ({BY}) AS y, row_number() OVER ({BY}) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT *, lag(y) OVER ({BY}) / -2 AS p FROM r), t AS (SELECT event_type, p, y, sign(p) * y AS s FROM g WHERE i > floor(7e-1 * n) AND p IS NOT NULL AND y IS NOT NULL)
SELECT event_type, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(corr(p, y), 4) + 0e0 AS corr, round(avg(CASE WHEN sign(p) = sign(y) THEN 1e0 ELSE 0e0 END), 4) AS direction,
  round(CASE WHEN stddev_samp(s) > 1e-12 THEN avg(s) / stddev_samp(s) * sqrt(252e0 * 39) ELSE 0e0 END, 4) + 0e0 AS sharpe FROM t GROUP BY 1""",
}

SQL |= {
    "padded_bars": """
WITH b AS (SELECT user_id, date_trunc('hour', ts) AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, unnest(generate_series(min(bar), max(bar), INTERVAL 1 HOUR)) AS bar FROM b GROUP BY 1),
f AS (SELECT s.user_id, s.bar, open, high, low, n, last_value(close IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.bar ROWS UNBOUNDED PRECEDING) AS close FROM s LEFT JOIN b USING (user_id, bar))
SELECT user_id, bar, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(n, 0) AS n FROM f""",
    "covariance_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 3) + 0e0 AS cov FROM lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i:]
    ),
    "weighted_moments": """
SELECT l_returnflag, l_linestatus, round(w, 6) AS weight, round(wv / w, 6) AS mean, round(sqrt(greatest(wvv / w - (wv / w) * (wv / w), 0e0)), 6) AS sd
FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS w, sum(l_quantity * l_discount) AS wv, sum(l_quantity * l_discount * l_discount) AS wvv FROM lineitem GROUP BY ALL)""",
    "restored_values": "SELECT event_id, round(value, 6) + 0e0 AS restored FROM events",
}

SQL["rolling_pyramid"] = f"""{BOOK},
s AS (SELECT symbol, seq, rel_spread, {', '.join(f'{book_plans._stat[n]} AS {n}' for n in PYRAMID if n != 'rel_spread')} FROM b),
l AS (SELECT symbol, seq, feature, x, row_number() OVER (PARTITION BY symbol, feature ORDER BY seq) AS i FROM (UNPIVOT s ON {', '.join(PYRAMID)} INTO NAME feature VALUE x))
{' UNION ALL '.join(f'''SELECT symbol, seq, feature, {size} AS "window", CASE WHEN c >= {max(1, size // 2)} THEN round(m, 5) + 0e0 END AS mean, CASE WHEN c >= {max(1, size // 2)} THEN round(sd, 5) END AS sd,
  CASE WHEN c >= {max(3, size // 2)} AND v > 1e-14 THEN round(sk, 5) + 0e0 END AS skew, CASE WHEN feature IN ('imbalance_L1', 'imbalance_L5') AND c = {size} THEN round(sl, 5) + 0e0 END AS slope
FROM (SELECT symbol, seq, feature, count(x) OVER w AS c, avg(x) OVER w AS m, stddev_samp(x) OVER w AS sd, var_pop(x) OVER w AS v, CASE WHEN var_pop(x) OVER w > 1e-14 THEN skewness(x) OVER w END AS sk, regr_slope(x, i) OVER w AS sl
  FROM l WINDOW w AS (PARTITION BY symbol, feature ORDER BY seq ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW))''' for size in Y.WINDOWS)}"""

SQL["surprise_scores"] = f"""{BOOK},
p AS (SELECT symbol, seq, row_number() OVER ({_SYM}) - 1 AS r, bn, an, coalesce(lag(bn) OVER ({_SYM}), bn) AS bn0, coalesce(lag(an) OVER ({_SYM}), an) AS an0 FROM b),
d AS (SELECT symbol, seq, r, k, CASE WHEN k <= 10 THEN abs(bn[k] - bn0[k]) ELSE abs(an[k - 10] - an0[k - 10]) END AS d FROM p, unnest(range(1, 21)) AS t(k)),
m AS (SELECT i.symbol, i.seq, i.r, i.k, any_value(i.d) AS d, sum({_RECENT} * j.d) / sum({_RECENT}) AS m FROM d i JOIN d j ON j.symbol = i.symbol AND j.k = i.k AND j.r <= i.r GROUP BY ALL)
SELECT symbol, seq, round(sum(CASE WHEN r >= 10 THEN (d - m) * (d - m) / (m + {_EPS}) ELSE 0e0 END), 2) AS surprise_score FROM m GROUP BY ALL"""

SQL["type_masks"] = f"SELECT feature, list_aggregate(list_transform(range(0, 4), lambda k: CASE WHEN type = k THEN '1' ELSE '0' END), 'string_agg', '') AS mask FROM ({market.SQL["feature_types"]})"

SQL["feature_matrix"] = f"""SELECT * FROM ({book_plans.SQL['book_static']}) JOIN ({book_plans.SQL['book_dynamic']}) USING (symbol, seq) JOIN ({book_plans.SQL['book_hidden']}) USING (symbol, seq) JOIN ({book_plans.SQL['book_targets']}) USING (symbol, seq)
JOIN (SELECT symbol, seq, spread, rel_spread FROM ({book_plans.SQL['book_normalize']})) USING (symbol, seq) JOIN ({book_plans.SQL['vwap_impact']}) USING (symbol, seq) JOIN ({SQL['surprise_scores']}) USING (symbol, seq)
JOIN (SELECT symbol, seq, pressure AS mm_inventory_pressure FROM ({model_plans.SQL['inventory_pressure']})) USING (symbol, seq)"""

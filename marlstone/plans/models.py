"""Queries of the decayed sums and of the sequential models, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scalars import log
from marlstone.operators import decay as D
from marlstone.operators import fractal as FR
from marlstone.operators import halo as H
from marlstone.operators import models as M
from marlstone.operators import modes as D2
from marlstone.operators import portfolio as P
from marlstone.operators import regimes as R
from marlstone.operators import running as U
from marlstone.operators import signals as G
from marlstone.operators import statespace as SP
from marlstone.operators import windows as W
from marlstone.plans.book import BOOK, rounded, snapshots
from marlstone.plans.queries import KEYS, ORDER, events

ID = "event_id"
LAGS = 10
TAUS, WEIGHTS = (3600.0, 86400.0), (1.0, 0.5)


def seconds(spark, sf_dir):
    return events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def decayed_flow(spark, sf_dir):
    return rounded(D.decayed_flow(seconds(spark, sf_dir), "at", "value", KEYS, ID, TAUS, WEIGHTS).select(ID, "flow"), ID, places=4)


def weighted_mean(spark, sf_dir):
    return rounded(D.weighted_mean(events(spark, sf_dir), "value", KEYS, ORDER, 10).select(ID, "ewm", "ewm_sd"), ID)


def online_slope(spark, sf_dir):
    rows = W.returns(events(spark, sf_dir), "value", KEYS, ORDER).withColumn("before", F.lag("diff").over(W.ordered(KEYS, ORDER))).filter("before IS NOT NULL")
    return rounded(D.online_slope(rows, "before", "diff", KEYS, ORDER, 0.1).select(ID, "beta"), ID)


def inventory_pressure(spark, sf_dir):
    rows = snapshots(spark, sf_dir).withColumn("gap", F.aggregate("bid_notional", F.lit(0.0), lambda s, x: s + x) - F.aggregate("ask_notional", F.lit(0.0), lambda s, x: s + x))
    flow = rows.withColumn("flow", F.col("gap") - F.coalesce(F.lag("gap").over(W.ordered(["symbol"], ["seq"])), F.col("gap")))
    return rounded(D.weighted_mean(flow, "flow", ["symbol"], ["seq"], 100).select("symbol", "seq", F.col("ewm").alias("pressure")), "symbol", "seq", places=4)


def _before(spark, sf_dir):
    """Events with the value before, in hundreds."""
    rows = events(spark, sf_dir)
    return rows.withColumn("before", F.lag("value").over(W.ordered(KEYS, ORDER)) / 100).select(ID, "user_id", "ts", "before", "value")


def kalman_line(spark, sf_dir):
    return rounded(SP.kalman_line(_before(spark, sf_dir), "before", "value", KEYS, ORDER, prior=100.0).select(ID, "alpha", "beta", "alpha_sd", "beta_sd"), ID, places=4)


def smoothed_line(spark, sf_dir):
    found = SP.walking_regression(_before(spark, sf_dir), ["before"], "value", KEYS, ORDER, prior=100.0)
    named = {f"{n}{tail}": F.col(f"coef{tail}")[i] for tail in ("", "_sd") for i, n in enumerate(("alpha", "beta"))}
    return rounded(found.select(ID, *[c.alias(n) for n, c in named.items()], "ahead", "ahead_sd", "fitted", "fitted_sd"), ID, places=4)


def fitted_line(spark, sf_dir):
    """One series an event type, so a few long ones, with variances of its own; the last tenth of each is forecast."""
    w = W.ordered(["event_type"], ORDER)
    rows = events(spark, sf_dir).withColumn("before", F.lag("value").over(w) / 100).withColumn("late", F.percent_rank().over(w) > 0.9)
    rows = rows.select(ID, "event_type", "user_id", "ts", "before", F.when(~F.col("late"), F.col("value")).alias("value"))
    found = SP.walking_regression(rows, ["before"], "value", ["event_type"], ORDER, rounds=4)
    return found.select(ID, "coef", "coef_sd", "fitted", "fitted_sd", "noise", "drift", "loglik")


def regime_regression(spark, sf_dir):
    rows = W.returns(events(spark, sf_dir), "value", KEYS, ORDER).withColumn("before", F.lag("diff").over(W.ordered(KEYS, ORDER)))
    return R.regime_regression(rows.select(ID, "user_id", "ts", "before", "diff"), ["before"], "diff", KEYS, ORDER).select(ID, "state", "p_state", "fitted", "loglik")


def regime_forecasts(spark, sf_dir):
    """The next change, by regimes fitted on the first 70 % of each event type's rows."""
    rows = U.neighbours(events(spark, sf_dir), "value", ["event_type"], ORDER, {"b1": -1, "b2": -2, "a1": 1})
    rows = rows.withColumns({"before": F.col("b1") - F.col("b2"), "diff": F.col("value") - F.col("b1"), "next": F.col("a1") - F.col("value")})
    found = R.walk_forward(rows.select(ID, "event_type", "user_id", "ts", "before", "diff", "next"), ["before", "diff"], "next", ["event_type"], ORDER)
    return found.select(ID, "event_type", "is_train", "p_ahead", "p_filtered", "state", "path", "guess", "next")


def regime_report(spark, sf_dir):
    """How good those forecasts are on the rest."""
    return P.forecast_strategy(regime_forecasts(spark, sf_dir).filter("NOT is_train"), "guess", "next", ["event_type"])


def fluctuation_exponents(spark, sf_dir):
    found = M.fluctuation_exponents(events(spark, sf_dir).select(ID, "ts", "user_id", "value"), "value", KEYS, ORDER)
    return found.withColumn("regime", FR.regime(F.col("h")[0], F.col("h")[3], F.col("h")[6]))


def window_exponents(spark, sf_dir):
    """Of the log returns of each event type's values, windows of 256 every 60 rows."""
    rows = U.lagged(events(spark, sf_dir), "value", ["event_type"], ORDER, "before")
    rows = rows.select(ID, "ts", "event_type", (log(F.col("value")) - log(F.col("before"))).alias("logret"))
    found = FR.window_exponents(rows, "logret", ["event_type"], ORDER)
    return rounded(found.select("event_type", "window", ID, *[F.col("h")[i].alias(f"h{i + 1}") for i in range(7)]), "event_type", "window", ID).withColumn("regime", FR.regime(F.col("h1"), F.col("h4"), F.col("h7")))


def mode_decomposition(spark, sf_dir):
    return D2.mode_decomposition(events(spark, sf_dir).select(ID, "ts", "user_id", "value"), "value", KEYS, ORDER, most=4).select(ID, "modes")


def _noisy_modes(spark, sf_dir):
    return D2.mode_decomposition(events(spark, sf_dir).select(ID, "ts", "user_id", "value"), "value", KEYS, ORDER, most=4, trials=4, abnormal=2).select(ID, "ts", "user_id", "modes")


def noise_assisted_modes(spark, sf_dir):
    """Up to two rough modes from four pairs of trials each, then the modes of the rest, neighbours of like disorder added up."""
    return D2.merged_modes(_noisy_modes(spark, sf_dir), KEYS, ORDER).select("user_id", ID, "component", "x")


def component_forecasts(spark, sf_dir):
    """How good the sums of the components' forecasts are on the last fifth of each user's rows."""
    merged = D2.merged_modes(_noisy_modes(spark, sf_dir), KEYS, ORDER)
    return G.errors(D2.component_forecasts(merged, KEYS, ORDER).filter("NOT is_train"), "actual", "guess", KEYS)


def rolling_factors(spark, sf_dir):
    """The whole table as one series of books, at the default sizes: 40 columns, windows of 200, eight components."""
    rows = snapshots(spark, sf_dir).select("seq", F.concat("bid_size_norm", "ask_size_norm", "bid_price_norm", "ask_price_norm").alias("v"))
    return H.rolling_factors(rows, "v", 40, [], ["seq"]).select("seq", "factors")


def _panel(spark, sf_dir):
    """The mean value of each event type in each hour that has all five, in hundreds."""
    hours = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg((F.avg("value") / 100).alias("x"))
    whole = hours.filter("x IS NOT NULL").groupBy("hour").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "x"))), lambda e: e["x"]).alias("v"))
    return whole.filter(F.size("v") == 5)


def precision_strength(spark, sf_dir):
    """With the intensity of shrinkage of each window."""
    return H.rolling_precision(_panel(spark, sf_dir), "v", 5, [], ["hour"], 100).select("hour", "strength")


def ridge_precision(spark, sf_dir):
    found = H.rolling_precision(_panel(spark, sf_dir), "v", 5, [], ["hour"], 100, shrink=False)
    return found.select("hour", *[(F.round(F.col("strength")[i], 5) + F.lit(0.0)).alias(f"s{i + 1}") for i in range(5)])


def wavelet_energies(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return M.wavelet_energies(rows, "v", 3).select("vec_id", *[F.round(F.col("energies")[i], 6).alias(f"e{i + 1}") for i in range(3)])


def self_excitation(spark, sf_dir):
    """Large values of each user, fitted on the first three weeks."""
    rows = events(spark, sf_dir).select(ID, "ts", "user_id", (F.col("value") > 400).cast("int").alias("large"))
    return rounded(H.self_excitation(rows, "large", KEYS, ORDER, LAGS, fit_until=F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")).select(ID, "intensity", "slope"), ID)


def metaorders(spark, sf_dir):
    rows = seconds(spark, sf_dir).withColumns({"score": F.col("value") - 250, "sign": F.signum(F.col("value") - 250).cast("int")})
    return M.metaorders(rows, "at", "score", "sign", KEYS, ORDER, 0.7, 0.4, 5 * 86400.0, 3)


QUERIES = {f.__name__: f for f in (decayed_flow, weighted_mean, online_slope, inventory_pressure, kalman_line, smoothed_line, fitted_line, regime_regression, regime_forecasts, regime_report, fluctuation_exponents, window_exponents, mode_decomposition, noise_assisted_modes, component_forecasts, rolling_factors, precision_strength, ridge_precision, wavelet_energies, self_excitation, metaorders)}

_BY = "PARTITION BY user_id ORDER BY ts, event_id"
_MEANS = """WITH w AS (SELECT a.{id} AS id, sum(pow({keep}, a.i - b.i)) AS w, sum(pow({keep}, 2 * (a.i - b.i))) AS w2, sum(pow({keep}, a.i - b.i) * b.v) AS x, sum(pow({keep}, a.i - b.i) * b.v * b.v) AS xx
FROM n a JOIN n b ON a.k = b.k AND b.i <= a.i GROUP BY 1)"""

#: Filtered coefficients and their covariances, row by row: z is what the row before left, q the drift, r the noise.
_FILTER = f"""WITH RECURSIVE v AS (SELECT user_id, CASE WHEN var_pop(value) > 0 THEN var_pop(value) ELSE 1e0 END AS s FROM events GROUP BY 1),
n AS (SELECT event_id, user_id, s, x, value AS y, row_number() OVER ({_BY}) AS i, x IS NOT NULL AND value IS NOT NULL AS seen FROM (SELECT *, lag(value) OVER ({_BY}) / 100 AS x FROM events) JOIN v USING (user_id)),
z AS (SELECT CAST(NULL AS BIGINT) AS event_id, user_id, 0 AS i, 0e0 AS a, 0e0 AS b, 100 * s AS p, 0e0 AS o, 100 * s AS u, CAST(NULL AS DOUBLE) AS ahead, CAST(NULL AS DOUBLE) AS width FROM v
  UNION ALL SELECT event_id, user_id, i, a + CASE WHEN seen THEN g / w * (y - a - b * x) ELSE 0e0 END, b + CASE WHEN seen THEN h / w * (y - a - b * x) ELSE 0e0 END,
    p - CASE WHEN seen THEN g * g / w ELSE 0e0 END, o - CASE WHEN seen THEN g * h / w ELSE 0e0 END, u - CASE WHEN seen THEN h * h / w ELSE 0e0 END, CASE WHEN x IS NOT NULL THEN a + b * x END, sqrt(w)
  FROM (SELECT *, g + h * x + s AS w FROM (SELECT n.event_id, n.user_id, n.i, n.x, n.y, n.seen, n.s, a, b, p + 1e-3 * s AS p, o, u + 1e-3 * s AS u, p + 1e-3 * s + o * x AS g, o + (u + 1e-3 * s) * x AS h FROM z JOIN n ON n.user_id = z.user_id AND n.i = z.i + 1)))"""
#: The same backwards: from the last row on, each row's smoothed coefficients from those of the row after it.
_SMOOTH = """,
f AS (SELECT z.*, s, x, lead(z.i) OVER (PARTITION BY z.user_id ORDER BY z.i) IS NULL AS final FROM z JOIN n USING (event_id)),
e AS (SELECT *, (p * wu - o * o) / d AS e11, (o * wp - p * o) / d AS e12, (o * wu - u * o) / d AS e21, (u * wp - o * o) / d AS e22 FROM (SELECT *, wp * wu - o * o AS d FROM (SELECT *, p + 1e-3 * s AS wp, u + 1e-3 * s AS wu FROM f))),
k AS (SELECT event_id, user_id, i, a, b, p, o, u FROM e WHERE final
  UNION ALL SELECT e.event_id, e.user_id, e.i, e.a + e11 * (k.a - e.a) + e12 * (k.b - e.b), e.b + e21 * (k.a - e.a) + e22 * (k.b - e.b),
    e.p + e11 * e11 * (k.p - wp) + 2 * e11 * e12 * (k.o - e.o) + e12 * e12 * (k.u - wu), e.o + e11 * e21 * (k.p - wp) + (e11 * e22 + e12 * e21) * (k.o - e.o) + e12 * e22 * (k.u - wu),
    e.u + e21 * e21 * (k.p - wp) + 2 * e21 * e22 * (k.o - e.o) + e22 * e22 * (k.u - wu) FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i - 1)"""

def _eliminated(n: int) -> str:
    """Steps of elimination on e0 (id, r, v: row r of an n x n system with what stands right of it): in the last one the left half is the identity."""
    row = "list_transform(list_zip(a.v, p.v), lambda t: t[1] - a.v[{k}] / p.v[{k}] * t[2])"
    return ",\n".join(f"e{k} AS MATERIALIZED (SELECT a.id, a.r, CASE WHEN a.r = {k} THEN list_transform(a.v, lambda x: x / a.v[{k}]) ELSE {row.format(k=k)} END AS v FROM e{k - 1} a JOIN e{k - 1} p ON p.id = a.id AND p.r = {k})" for k in range(1, n + 1))


_SCALES = FR.scales_of(256)
_STARTS = ", ".join(f"({s}, {u}, {k})" for s in _SCALES for k, u in enumerate(FR.starts_of(256, s)))

SQL = {
    "ridge_precision": f"""
WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, avg(value) / 100 AS x FROM events GROUP BY ALL),
g AS (SELECT hour, list(x ORDER BY event_type) AS v FROM h WHERE x IS NOT NULL GROUP BY hour HAVING count(*) = 5),
n AS (SELECT *, row_number() OVER (ORDER BY hour) AS i FROM g),
c AS (SELECT a.i AS id, r, c, covar_samp(b.v[r], b.v[c]) + CASE WHEN r = c THEN 2e-3 ELSE 0e0 END AS x FROM n a JOIN n b ON b.i >= a.i - 100 AND b.i < a.i, range(1, 6) t(r), range(1, 6) u(c) WHERE a.i > 100 GROUP BY a.i, r, c),
e0 AS (SELECT id, r, list(x ORDER BY c) || list_transform(range(1, 6), lambda c: CASE WHEN c = r THEN 1e0 ELSE 0e0 END) AS v FROM c GROUP BY id, r),
{_eliminated(5)},
s AS (SELECT id, r, list_sum(list_transform(v[6:10], lambda x: abs(x))) - abs(v[5 + r]) AS s FROM e5)
SELECT n.hour, {', '.join(f"round(max(CASE WHEN r = {k} THEN s END), 5) + 0e0 AS s{k}" for k in range(1, 6))} FROM n LEFT JOIN s ON s.id = n.i GROUP BY n.hour""",
    "self_excitation": f"""
WITH n AS (SELECT event_id, user_id, ts, CASE WHEN value > 400 THEN 1e0 ELSE 0e0 END AS e, ts < TIMESTAMP '2024-01-22' AS fits, row_number() OVER ({_BY}) AS i FROM events),
p AS (SELECT *, [{', '.join(f'lag(e, {k}) OVER ({_BY})' for k in range(1, LAGS + 1))}] AS x FROM n),
k AS (SELECT user_id, count(*) AS m, avg(e) AS mean FROM n WHERE fits GROUP BY 1),
f AS (SELECT user_id AS id, e, x FROM p JOIN k USING (user_id) WHERE fits AND i > {LAGS} AND m > {LAGS + 1}),
g AS (SELECT id, r, c, sum(x[r] * CASE WHEN c <= {LAGS} THEN x[c] ELSE e END) + CASE WHEN r = c THEN 1e-3 ELSE 0e0 END AS x FROM f, range(1, {LAGS + 1}) t(r), range(1, {LAGS + 2}) u(c) GROUP BY id, r, c),
e0 AS (SELECT id, r, list(x ORDER BY c) AS v FROM g GROUP BY id, r),
{_eliminated(LAGS)},
a AS (SELECT id, list(v[{LAGS + 1}] ORDER BY r) AS a FROM e{LAGS} GROUP BY id),
b AS (SELECT id, any_value(a) AS a, greatest(1e-6, avg(e) - avg(list_sum(list_transform(list_zip(x, a), lambda t: t[1] * t[2])))) AS mu FROM f JOIN a USING (id) GROUP BY id),
r AS (SELECT event_id, p.user_id, i, CASE WHEN b.id IS NULL THEN coalesce(k.mean, 0e0) WHEN i <= {LAGS} THEN mu ELSE greatest(mu + list_sum(list_transform(list_zip(x, a), lambda t: t[1] * t[2])), 1e-6) END AS rate FROM p LEFT JOIN b ON b.id = p.user_id LEFT JOIN k ON k.user_id = p.user_id)
SELECT event_id, round(rate, 6) + 0e0 AS intensity, round(coalesce(rate - lag(rate) OVER (PARTITION BY user_id ORDER BY i), 0e0), 6) + 0e0 AS slope FROM r""",
    "window_exponents": f"""
WITH r AS (SELECT event_type, event_id, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events),
l AS (SELECT event_type, event_id, ln(value) - ln(b) AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r WHERE value > 0 AND b > 0),
w AS (SELECT event_type, k, i - 60 * k AS j, y, event_id FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 255) / 60e0) AS BIGINT)), i // 60 + 1)) AS k FROM l) WHERE 60 * k < n - 256),
p AS (SELECT *, sum(y - m) OVER (PARTITION BY event_type, k ORDER BY j) AS p FROM (SELECT *, avg(y) OVER (PARTITION BY event_type, k) AS m FROM w)),
c AS (SELECT * FROM (VALUES {_STARTS}) t(s, u, g)),
f AS (SELECT event_type, k, s, g, (regr_syy(p, j) - pow(regr_sxy(p, j), 2) / regr_sxx(p, j)) / s AS f, sum(p * p) AS yy FROM p JOIN c ON j >= u AND j < u + s GROUP BY event_type, k, s, g),
q AS (SELECT event_type, k, s, q, ln(avg(pow(f, q / 2e0))) / q AS lf, min(f * s / yy) AS least FROM f, (VALUES (-5), (-3), (-1), (1), (2), (3), (5)) t(q) GROUP BY event_type, k, s, q),
h AS (SELECT event_type, k, q, CASE WHEN min(least) > 1e-11 THEN round(regr_slope(lf, ln(s)), 6) + 0e0 END AS h FROM q GROUP BY event_type, k, q),
o AS (SELECT event_type, k AS "window", {', '.join(f"max(CASE WHEN q = {q} THEN h END) AS h{i + 1}" for i, q in enumerate(FR.QS))} FROM h GROUP BY event_type, k)
SELECT o.*, event_id, CASE WHEN h1 IS NULL THEN 'insufficient' WHEN h7 > 65e-2 AND h4 > 5e-1 THEN 'strong trend' WHEN h1 < 35e-2 AND h4 < 5e-1 THEN 'strong reversion' WHEN h7 > 5e-1 AND h1 < 5e-1 THEN 'mixed' ELSE 'random' END AS regime
FROM o JOIN w ON w.event_type = o.event_type AND w.k = o."window" AND w.j = 255""",
    "kalman_line": f"{_FILTER} SELECT event_id, round(a, 4) + 0e0 AS alpha, round(b, 4) + 0e0 AS beta, round(sqrt(p), 4) + 0e0 AS alpha_sd, round(sqrt(u), 4) + 0e0 AS beta_sd FROM z WHERE i > 0",
    "smoothed_line": f"""{_FILTER}{_SMOOTH}
SELECT k.event_id, round(k.a, 4) + 0e0 AS alpha, round(k.b, 4) + 0e0 AS beta, round(sqrt(k.p), 4) + 0e0 AS alpha_sd, round(sqrt(k.u), 4) + 0e0 AS beta_sd, round(f.ahead, 4) + 0e0 AS ahead, round(CASE WHEN f.x IS NOT NULL THEN f.width END, 4) + 0e0 AS ahead_sd,
  round(k.a + k.b * f.x, 4) + 0e0 AS fitted, round(sqrt(k.p + 2 * k.o * f.x + k.u * f.x * f.x + f.s), 4) + 0e0 AS fitted_sd FROM k JOIN f USING (event_id)""",
    "inventory_pressure": f"""{BOOK},
g AS (SELECT symbol, seq, list_sum(bn) - list_sum(an) AS gap, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i FROM b),
f AS (SELECT symbol, seq, i, gap - coalesce(lag(gap) OVER (PARTITION BY symbol ORDER BY seq), gap) AS flow FROM g)
SELECT a.symbol, a.seq, round(sum(pow(99e0 / 101, a.i - b.i) * b.flow) / sum(pow(99e0 / 101, a.i - b.i)), 4) + 0e0 AS pressure FROM f a JOIN f b ON b.symbol = a.symbol AND b.i <= a.i GROUP BY ALL""",
    "decayed_flow": """
WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) / 1e6 AS at FROM events)
SELECT a.event_id, round(sum(b.value * (exp((b.at - a.at) / 3600) + 5e-1 * exp((b.at - a.at) / 86400))), 4) + 0e0 AS flow
FROM e a JOIN e b ON a.user_id = b.user_id AND (b.at < a.at OR b.at = a.at AND b.event_id <= a.event_id) GROUP BY 1""",
    "weighted_mean": f"""
WITH n AS (SELECT event_id, user_id AS k, value AS v, row_number() OVER ({_BY}) AS i FROM events), {_MEANS.format(id='event_id', keep='(9e0 / 11)')[5:]}
SELECT id AS event_id, round(x / w, 6) + 0e0 AS ewm, round(sqrt(greatest(xx / w - pow(x / w, 2), 0) * (w * w / nullif(round(w * w - w2, 12), 0))), 6) AS ewm_sd FROM w""",
    "online_slope": f"""
WITH RECURSIVE d AS (SELECT *, value - lag(value) OVER ({_BY}) AS d FROM events), b AS (SELECT *, lag(d) OVER ({_BY}) AS x FROM d),
n AS (SELECT event_id, user_id, x, d AS y, row_number() OVER ({_BY}) AS i FROM b WHERE x IS NOT NULL),
m AS (SELECT event_id, user_id, i, x * x AS xx, x * y AS xy, CAST(NULL AS DOUBLE) AS beta FROM n WHERE i = 1
  UNION ALL SELECT n.event_id, n.user_id, n.i, 9e-1 * xx + 1e-1 * n.x * n.x, 9e-1 * xy + 1e-1 * n.x * n.y, xy / (xx + 1e-6) FROM m JOIN n ON n.user_id = m.user_id AND n.i = m.i + 1)
SELECT event_id, round(beta, 6) + 0e0 AS beta FROM m""",
    "wavelet_energies": """
WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
b AS (SELECT *, list_transform(range(1, 33), lambda i: (a[2 * i - 1] - a[2 * i]) / sqrt(2e0)) AS d1, list_transform(range(1, 33), lambda i: (a[2 * i - 1] + a[2 * i]) / sqrt(2e0)) AS s1 FROM a),
c AS (SELECT *, list_transform(range(1, 17), lambda i: (s1[2 * i - 1] - s1[2 * i]) / sqrt(2e0)) AS d2, list_transform(range(1, 17), lambda i: (s1[2 * i - 1] + s1[2 * i]) / sqrt(2e0)) AS s2 FROM b),
d AS (SELECT *, list_transform(range(1, 9), lambda i: (s2[2 * i - 1] - s2[2 * i]) / sqrt(2e0)) AS d3 FROM c)
SELECT vec_id, round(list_sum(list_transform(d1, lambda x: x * x)) / 32, 6) AS e1, round(list_sum(list_transform(d2, lambda x: x * x)) / 16, 6) AS e2, round(list_sum(list_transform(d3, lambda x: x * x)) / 8, 6) AS e3 FROM d""",
}

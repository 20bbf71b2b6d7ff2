"""What the SQL comparisons cannot reach: reports, the order-flow engine, metaorders, helpers, and clashing names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalars
from marlstone.operators import alpha, book, decay, flow, labels, portfolio, pyramid, series
from marlstone.operators.decay import power_law_mixture


def test_tails_of_t():
    for t, freedom, p in ((0.0, 10, 1.0), (2.2281388519649385, 10, 0.05), (-1.6448536, 10**7, 0.1), (3.169272672616872, 10, 0.01), (0.5, 3, 0.6514476)):
        assert math.isclose(pyramid.t_tail(t, freedom), p, rel_tol=1e-5)


def test_clean_features_follow_the_greedy_rule(spark):
    r = np.random.default_rng(4)
    y = r.normal(size=400)
    cols = {"a": y + 0.5 * r.normal(size=400), "c": r.normal(size=400)}
    cols |= {"b": cols["a"] + 0.05 * r.normal(size=400), "d": -y + 2 * r.normal(size=400)}
    df = spark.createDataFrame([tuple(map(float, row)) for row in zip(cols["a"], cols["b"], cols["c"], cols["d"], y)], "a double, b double, c double, d double, y double")
    report = pyramid.information_report(df, ["a", "b", "c", "d"], "y").collect()
    assert [abs(x.ic) for x in report] == sorted((abs(x.ic) for x in report), reverse=True)
    assert {x.feature: x.significant for x in report if x.feature != "c"} == {"a": True, "b": True, "d": True}
    kept = pyramid.clean_features(df, ["a", "b", "c", "d"], "y")
    assert kept[0] == report[0].feature and "d" in kept and not {"a", "b"} <= set(kept)
    assert pyramid.clean_features(df.withColumn("y", F.rand(1)), ["c"], "y") == ["c"]


def engine(trades, quotes, depth, taus, weights, step, horizon, alpha=0.05, ridge=1e-4, tick=0.01, widest=2, least=200, fee=1.0, slip=0.2):
    last = lambda rows, t: next((x for x in reversed(rows) if x[0] <= t), None)
    a = math.ceil(max(x[0][0] for x in (trades, quotes, depth)))
    b = math.floor(min(x[-1][0] for x in (trades, quotes, depth)))
    times = np.arange(a, b + 1e-9, step)
    mid = [(q[1] + q[2]) / 2 if (q := last(quotes, t)) else math.nan for t in times]
    signed, previous = [], trades[0][1]
    for t, price, qty, way in trades:
        at = max(0, int(np.searchsorted(times, t, side="right")) - 1)
        if not way:
            way = 1 if price > mid[at] else -1 if price < mid[at] else 1 if price >= previous else -1
        signed.append((t, way * math.sqrt(qty)))
        previous = price
    mxx, mxy, beta, guesses, real, n, pnl, traded = 1e-6, 0.0, 0.0, [], [], 0, 0.0, 0.0
    h = round(horizon / step)
    for i, t in enumerate(times):
        now = max((s for s, _ in signed if s <= t), default=None)
        x = 0.0 if now is None else sum(w * sum(q * math.exp((s - now) / tau) for s, q in signed if s <= t) for tau, w in zip(taus, weights))
        y = math.log(mid[i + h] / mid[i]) if i + h < len(times) else math.nan
        if not math.isnan(y):
            mxx, mxy = (1 - alpha) * mxx + alpha * x * x, (1 - alpha) * mxy + alpha * x * y
            beta = mxy / (mxx + ridge)
            guesses.append(beta * x)
            real.append(y)
        q, d = last(quotes, t), last(depth, t)
        half = (q[2] - q[1]) / tick / 2
        if 2 * half <= widest and d[1] + d[2] >= least and not math.isnan(y) and abs(beta * x) > (half + slip) * tick / mid[i]:
            n, traded = n + 1, traded + mid[i]
            pnl += (1 if beta * x > 0 else -1) * mid[i] * y - 2 * ((half + slip) * tick + fee * 1e-4 * mid[i])
    return np.corrcoef(guesses, real)[0, 1], beta, n, pnl, traded / max(n, 1), len(real), np.mean(guesses) / (np.std(guesses) + 1e-9)


def test_engine_equals_a_loop(spark):
    r = random.Random(2)
    price, trades, quotes, depth = 100.0, [], [], []
    for i in range(150):
        t = i + r.random()
        price += r.choice((-0.05, 0.0, 0.05))
        quotes.append((t, price - 0.01, price + r.choice((0.0, 0.01))))
        depth.append((t + 0.1, r.randint(50, 300), r.randint(50, 300)))
        trades.append((t + 0.2, round(price + r.choice((-0.01, 0.0, 0.01)), 2), r.randint(1, 50), r.choice((1, -1, 0, None))))
    frame = lambda rows, names: spark.createDataFrame([("s", i, float(x[0]), *[None if v is None else float(v) for v in x[1:]]) for i, x in enumerate(rows)], f"k string, id long, at double, {names}")
    got = flow.flow_engine(frame(trades, "price double, qty double, aggressor double"), frame(quotes, "bid double, ask double"), frame(depth, "bid_sz double, ask_sz double"), ["k"], "at", "id", horizon=10.0).first()
    want = engine(trades, quotes, depth, *power_law_mixture(0.05, 10, 0.1, 600.0), 1.0, 10.0)
    names = ("corr_pred_realized", "beta_hat", "n_trades", "pnl_price_units", "avg_trade_notional", "obs_count", "sharpe_like_of_preds")
    for name, value in zip(names, want):
        assert math.isclose(got[name], value, rel_tol=1e-6, abs_tol=1e-9), name
    assert got.n_trades > 0


def test_metaorders_are_found_where_trades_cluster(spark):
    rows = [(i, float(t), 1.0, 1) for i, t in enumerate(np.arange(0, 200, 4.0))]
    rows += [(1000 + i, 100 + 0.2 * i, 50.0, -1) for i in range(60)]
    trades = spark.createDataFrame([("s", *r) for r in rows], "k string, id long, at double, qty double, sign int")
    found = flow.detect_metaorders(trades, "at", "qty", "sign", ["k"], "id", start=0.9, stop=0.8).collect()
    assert len(found) == 1 and found[0].sign == -1 and found[0].n_child >= 40 and 100 <= found[0].t0 < found[0].t1


def test_mapped_metaorders_are_runs(spark):
    r = random.Random(1)
    trades = spark.createDataFrame([("s", i, float(i), r.randint(1, 9), r.choice((1, -1))) for i in range(600)], "k string, id long, at double, qty int, sign int")
    run = lambda **o: flow.mapped_metaorders(trades, "at", "qty", "sign", ["k"], ["at", "id"], "id", **o).orderBy("t0").collect()
    found = run(traders=3)
    assert found == run(traders=3) and all(x.n_child == x.t1 - x.t0 + 1 > 1 for x in found) and all(a.t1 < b.t0 for a, b in zip(found, found[1:]))
    assert [(x.n_child, x.vol) for x in run(traders=1, sticky=1.0)] == [(600, trades.agg(F.sum("qty")).first()[0])]


def test_names_of_the_caller_stay(spark):
    wide = {f"{s}_{f}_{k}": (100 + (k if s == "ask" else -k) * 0.01 if f == "price" else k) for s in ("bid", "ask") for f in ("price", "size") for k in range(1, 11)}
    rows = spark.createDataFrame([("a", i, i, *map(float, wide.values())) for i in range(3)], "symbol string, seq int, _tag int, " + ", ".join(f"{c} double" for c in wide))
    whole = pyramid.feature_matrix(book.normalize(book.from_wide(rows)), ["symbol"], ["seq"], (1,))
    assert whole.count() == 3
    kept = book.targets(book.normalize(book.from_wide(rows)), ["symbol"], ["seq"], (1,))
    assert [r._tag for r in kept.orderBy("seq").collect()] == [0, 1, 2]
    lines = spark.createDataFrame([(g, float(i), float(i % 7), float(i)) for g in (1, 2) for i in range(40)], "k int, y double, x double, n double")
    assert portfolio.threshold_regression(lines, "y", "x", "n", ["k"], 5).count() == 2


def test_helpers(spark):
    assert [labels.bar_seconds(x) for x in ("10S", "1min", "2h", "1D", "min", "??")] == [10, 60, 7200, 86400, 60, 60]
    row = spark.range(1).select(
        scalars.finite(F.lit(float("inf"))).alias("a"), scalars.clip(F.lit(3.0), 0.0, 1.0).alias("b"), scalars.ratio_or_zero(F.lit(1.0), F.lit(0.0)).alias("c"), scalars.sigmoid(F.lit(0.0)).alias("d"),
        scalars.softmax(F.array(F.lit(0.0), F.lit(math.log(3)))).alias("e"), scalars.normal_logpdf(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (None, 1.0, 0.0, 0.5) and math.isclose(row.e[1], 0.75) and math.isclose(row.f, -0.5 * math.log(2 * math.pi))
    taus, weights = power_law_mixture()
    at = np.array([0.5, 5.0, 50.0])
    assert np.allclose(np.exp(-at[:, None] / taus) @ weights, 1 / np.sqrt(at + 1), rtol=0.05)


@pytest.mark.parametrize(("hold", "most"), [(3, 1), (4, 2), (50, 3)])
def test_capped_strategy_counts_what_is_open(spark, hold, most):
    r = random.Random(hold)
    rows = [("s", i, r.choice((-6.0, 0.0, 6.0)), r.random()) for i in range(60)]
    held, want = [], []
    for _, i, score, ret in rows:
        held = [(e, s) for e, s in held if e > i]
        opens = score != 0 and len(held) < most
        held += [(max(min(i + hold, 59), i + 1), math.copysign(1, score))] * opens
        want.append((opens, sum(s for _, s in held) * ret))
    df = spark.createDataFrame(rows, "k string, i int, score double, ret double")
    got = [(x.opened, x.pnl) for x in portfolio.capped_strategy(df, "score", "ret", ["k"], ["i"], 5.0, hold, most).orderBy("i").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_wavelet_clusters_tell_rough_from_smooth(spark):
    r = random.Random(5)
    rows = [(k, i, 5.0 * (-1) ** i + 0.01 * r.random() if k == "rough" else 0.001 * i) for k in ("rough", "smooth") for i in range(60)] + [("short", 0, 1.0)]
    got = alpha.wavelet_clusters(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["k"], ["i"], 16, 4, 2, 3).collect()
    classes = {k: {x.cluster for x in got if x.k == k} for k in ("rough", "smooth", "short")}
    assert len(got) == 121 and classes["short"] == {None} and len(classes["rough"]) == len(classes["smooth"]) == 1 and classes["rough"] != classes["smooth"]


def test_constant_groups_have_no_correlation(spark):
    rows = spark.createDataFrame([(g, float(i % 7) if g else 1.0, float(i), 0.0) for g in (0, 1) for i in range(40)], "g int, x double, y double, z double")
    ranks = {r.g: r.ic for r in series.rank_correlation(rows, "x", "y", ["g"]).collect()}
    assert ranks[0] is None and ranks[1] is not None
    assert {(r.a, r.b): r["corr"] is None for r in portfolio.correlations(rows, ["x", "y", "z"]).collect()} == {("x", "y"): False, ("x", "z"): True, ("y", "z"): True}
    held = {r.g: r["corr"] for r in portfolio.forecast_strategy(rows, "x", "y", ["g"]).collect()}
    assert held[0] is None and held[1] is not None
    report = {r.feature: r.ic for r in pyramid.information_report(rows, ["x", "z"], "y").collect()}
    assert set(report) == {"x"}
    assert "z" not in pyramid.clean_features(rows.withColumn("w", F.col("y") + F.col("x")), ["w", "z"], "y")


@pytest.mark.parametrize("span", [1, 3, 40, 900])
def test_weighted_means_equal_a_loop(spark, span):
    r = np.random.default_rng(span)
    rows = [(["a", None, "b"][i % 3], i, None if i % 7 == 3 or i < 4 else float(100 + r.normal())) for i in range(600)]
    got = {(x.k, x.t): x for x in decay.weighted_mean(spark.createDataFrame(rows, "k string, t int, v double"), "v", ["k"], ["t"], span).collect()}
    keep = 1 - 2 / (span + 1)
    for key in ("a", None, "b"):
        seen = []
        for _, t, v in (x for x in rows if x[0] == key):
            seen += [] if v is None else [v]
            x = got[key, t]
            if not seen:
                assert x.ewm is None and x.ewm_sd is None
                continue
            w = keep ** np.arange(len(seen))[::-1]
            mean = (w * seen).sum() / w.sum()
            assert math.isclose(x.ewm, mean, rel_tol=1e-9)
            if len(seen) < 2:
                assert x.ewm_sd is None
            elif span > 1:
                bias = w.sum() ** 2 / (w.sum() ** 2 - (w * w).sum())
                assert math.isclose(x.ewm_sd, math.sqrt((w * (np.array(seen) - mean) ** 2).sum() / w.sum() * bias), rel_tol=1e-5)

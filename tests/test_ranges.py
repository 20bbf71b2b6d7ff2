"""Ranks, lags and bars of series dealt to ranges, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import running, series


def test_lags_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE", 20)
    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else "ab"[i % 2], i, None if i % 11 == 0 else float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    got = {r.t: r.before for r in running.lagged(df, "v", ["k"], ["t"], "before").collect()}
    last, want = {}, {}
    for k, t, v in rows:
        want[t] = last.get(k)
        last[k] = v
    assert got == want


def test_neighbours_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE", 9)
    rng = np.random.default_rng(5)
    rows = [(None if i % 7 == 0 else "abc"[i % 3] if i % 50 else "z", i, None if i % 11 == 0 else float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    offsets = {"b1": -1, "b2": -2, "a1": 1, "a3": 3}
    got = {r.t: tuple(r[c] for c in offsets) for r in running.neighbours(df, "v", ["k"], ["t"], offsets).collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        own = [(t, v) for k, t, v in rows if k == key]
        for i, (t, _) in enumerate(own):
            want[t] = tuple(own[i + o][1] if 0 <= i + o < len(own) else None for o in offsets.values())
    assert got == want


def test_rank_correlation_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE", 40)
    rng = np.random.default_rng(4)
    rows = [("a" if i % 2 else None, float(rng.integers(0, 30)), float(rng.normal())) for i in range(400)] + [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("c", 1.0, 4.0), ("d", 1.0, 1.0), ("a", None, 1.0)]
    found = series.rank_correlation(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"])
    got = {r.k: (r.n, r.ic) for r in found.collect()}

    def ranks(v):
        v = np.array(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for k in ("a", None):
        x, y = zip(*[(x, y) for g, x, y in rows if g == k and x is not None])
        assert got[k][0] == len(x) and abs(got[k][1] - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-12
    assert got["c"] == (3, None) and got["d"] == (1, None)


def test_volume_bars_take_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE", 50)
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("t"), F.lit(2.0).alias("q"), F.col("id").cast("double").alias("p"))
    bars = series.volume_bars(df, "p", "q", ["k"], ["t"], 8.0)
    assert bars.rdd.getNumPartitions() >= 20
    got = {r.bar: (r.open, r.close, r.quantity) for r in bars.filter("k = 7").collect()}
    assert got == {0: (7.0, 307.0, 8.0), 1: (407.0, 707.0, 8.0), 2: (807.0, 907.0, 4.0)}

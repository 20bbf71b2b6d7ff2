"""Modes against plain versions on single series."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import modes, signals


def series(spark, **named):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in named.items() for i, v in enumerate(vs)], "k string, t int, v double").repartition(3)


def test_spline_has_the_cubic_through_its_points():
    """Any cubic is its own spline, inside and beyond the ends."""
    at = np.array([2, 3, 7, 8, 12, 19])
    p = np.array([0.01, -0.3, 2.0, 5.0])
    assert np.allclose(modes.spline(at, np.polyval(p, at), 25), np.polyval(p, np.arange(25)))
    v = np.random.default_rng(1).normal(size=6)
    assert np.allclose(modes.spline(at, v, 25)[at], v)
    assert np.allclose(modes.spline(at[:3], np.polyval(p[1:], at[:3]), 25), np.polyval(p[1:], np.arange(25))) and np.allclose(modes.spline(at[:2], np.array([1.0, 2.0]), 5), [-1, 0, 1, 2, 3])


def test_the_mean_that_is_small_enough_stays_on():
    t = np.arange(300)
    wave = np.sin(t / 3)
    assert np.array_equal(modes.sifted(wave), wave)  # its envelopes' mean is next to nothing: not taken off
    drift = wave + t / 20
    once = drift - sum(modes.spline(p, drift[p], 300) for p in modes.turns(drift)) / 2
    assert np.allclose(modes.sifted(drift), once)  # taken off once; what is left then stays
    line = np.arange(9.0)
    assert np.array_equal(modes.sifted(line), line) and len(modes.decomposed(line, 9)) == 1


def test_modes_sum_to_the_value(spark):
    t = np.arange(200)
    v = np.sin(t / 3) + np.sin(t / 20) + t / 50
    out = modes.mode_decomposition(series(spark, a=v, b=v[:7], c=[1.0]), "v", ["k"], ["t"]).collect()
    assert len(out) == 208 and all(np.isclose(sum(r.modes), r.v) and len(r.modes) == 10 for r in out)
    got = np.array([r.modes for r in sorted((r for r in out if r.k == "a"), key=lambda r: r.t)])
    assert np.corrcoef(got[20:180, 0], np.sin(t / 3)[20:180])[0, 1] > 0.9


def test_ensembles_take_rough_modes_off(spark):
    t = np.arange(240)
    r = np.random.default_rng(2)
    v = 3 * np.sin(t / 25) + 0.8 * r.normal(size=240)
    run = lambda **o: modes.mode_decomposition(series(spark, a=v), "v", ["k"], ["t"], most=3, trials=12, abnormal=2, **o).orderBy("t").collect()
    first, again = run(least_dimension=0.0), run(least_dimension=0.0)
    got = np.array([r.modes for r in first])
    assert np.allclose(got, np.array([r.modes for r in again])) and got.shape == (240, 6) and np.allclose(got.sum(1), v)
    assert (np.abs(got[:, :2]).max(0) > 0).all()
    none = np.array([r.modes for r in run(least_dimension=99.0)])
    assert np.allclose(none[:, 0], modes.decomposed(v, 3)[0])
    assert abs(modes.height_dimension(np.arange(5000.0)) - 1) < 0.01 and abs(modes.height_dimension(np.arange(5000) % 2 + 0.0)) < 1e-9


def test_merged_components_and_their_forecasts(spark):
    t = np.arange(400)
    r = np.random.default_rng(3)
    v = 10 * np.sin(t / 9) + 4 * np.sin(t / 40) + 0.3 * r.normal(size=400) + 50
    split = modes.mode_decomposition(series(spark, a=v, b=v[::-1].copy()), "v", ["k"], ["t"], most=5)
    merged = modes.merged_modes(split, ["k"], ["t"])
    sums = merged.groupBy("k", "t").agg(F.sum("x").alias("v"), F.count("*").alias("n")).orderBy("k", "t").collect()
    assert np.allclose([r.v for r in sums], [*v, *v[::-1]]) and all(r.n >= 1 for r in sums)
    said = modes.component_forecasts(merged, ["k"], ["t"], 6)
    late = said.filter("NOT is_train")
    assert late.count() == 160 and late.filter("t < 320").count() == 0
    errors = {r.k: r for r in signals.errors(late, "actual", "guess", ["k"]).collect()}
    assert all(e.r2 > 0.5 and e.mae < 2 for e in errors.values()), errors
    short = modes.merged_modes(modes.mode_decomposition(series(spark, a=[1.0, 2.0]), "v", ["k"], ["t"]), ["k"], ["t"])
    assert [(r.t, r.component, r.x) for r in short.orderBy("t").collect()] == [(0, 0, 1.0), (1, 0, 2.0)]

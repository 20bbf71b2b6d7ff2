"""Values below 0, minus 0 and NaN, as the SQL of the queries has them."""

import math

from pyspark.sql import functions as F

from marlstone.operators import labels, windows

INF, NAN = math.inf, math.nan


def series(spark, values):
    return spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, t int, v double")


def same(got, said):
    return len(got) == len(said) and all(g is None if s is None else g is not None and (g == s or math.isnan(g) and math.isnan(s) or math.isclose(g, s)) for g, s in zip(got, said))


def test_paths_below_zero_are_whole_and_nan(spark):
    df = series(spark, [1, 2, -3, 4, 4, 4, 4, 4])
    got = {r.t: r for r in windows.signature(df, "v", ["k"], ["t"], 3, zeros=True).collect()}
    assert same([got[t].s1_0 for t in range(2, 8)], [None, 1.0, 1.0, 1.0, 1.0, 1.0]) and same([got[t].s1_1 for t in range(3, 7)], [NAN, NAN, 0.0, 0.0])
    assert all(got[t].s1_0 is None for t in range(3)) and same([got[t].s1_3 for t in (4, 5, 6, 7)], [NAN, NAN, 0.0, 0.0])


def test_variance_below_zero_is_nan(spark):
    """Blocks of three steps of three rows weigh two steps by -1/6 and 1/6; row t takes the block of rows t - 5 to t - 3."""
    df = series(spark, [1, 2, -3, 4, 4, 4, 4, 4, 8, 8])
    got = [r.pav_rv for r in labels.pre_averaged_variance(df, "v", ["k"], ["t"], 3, 6, zeros=True).orderBy("t").collect()]
    assert same(got, [None] * 6 + [NAN, NAN, 0.0, 0.0])


def test_log_returns_below_zero_are_nan(spark):
    df = series(spark, [2, -1, 3, None, -0.0, 4])
    got = windows.returns(df, "v", ["k"], ["t"], zeros=True).orderBy("t").collect()
    assert same([r.logret for r in got], [None, NAN, NAN, None, None, INF]) and same([r.pct for r in got], [None, -1.5, -4.0, None, None, None])
    assert same([r.logret for r in windows.returns(df, "v", ["k"], ["t"]).orderBy("t").collect()], [None] * 6)


def test_barriers_order_values_as_sql_does(spark):
    """NaN is above every number and touches upper barriers; null touches none; a barrier of NaN is touched from below by all."""
    df = series(spark, [10, None, NAN, -0.0, 5, NAN]).withColumn("s", F.lit(0.1))
    got = labels.triple_barrier(df, "v", "s", ["k"], ["t"], 2.0, 1.5, 3, zeros=True).orderBy("t").collect()
    assert [(r.label, r.t_hit) for r in got] == [(1, 2), (0, 4), (-1, 3), (1, 4), (1, 5), (0, None)]
    assert same([r.ret for r in got], [NAN, None, NAN, -INF, NAN, None])
    plain = labels.triple_barrier(df, "v", "s", ["k"], ["t"], 2.0, 1.5, 3).orderBy("t").collect()
    assert [(r.label, r.t_hit) for r in plain][:2] == [(-1, 3), (0, 4)]


def test_sort_keys_follow_the_order_of_sql():
    import numpy as np

    v = np.array([-INF, -1e300, -1.0, -1e-300, 0.0, 1e-300, 1.0, 1e300, INF, NAN])
    keys = labels.sort_keys(v)
    assert (np.diff(keys.astype(object)) > 0).all() and (np.diff((-keys).astype(object)) < 0).all() and keys.min() > labels.LOWEST and (-keys).min() > labels.LOWEST
    assert labels.sort_keys(np.array([-0.0]))[0] == labels.sort_keys(np.array([0.0]))[0] and labels.sort_keys(np.array([-NAN]))[0] == keys[-1]

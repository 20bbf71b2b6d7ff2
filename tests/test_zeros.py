"""Values of 0: their logs, steps from them and ties of rounding, as the SQL of the queries has them."""

import math

from marlstone.operators import labels, windows
from marlstone.plans.book import rounded

INF = math.inf


def series(spark, values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, t int, v double")


def same(got, said):
    return len(got) == len(said) and all(g is None if s is None else g is not None and (g == s or math.isnan(g) and math.isnan(s) or math.isclose(g, s)) for g, s in zip(got, said))


def test_log_returns_over_a_zero(spark):
    df = series(spark, [2, 0, 0, 4])
    column = lambda **o: [r.logret for r in windows.returns(df, "v", ["k"], ["t"], **o).orderBy("t").collect()]
    assert same(column(zeros=True), [None, -INF, math.nan, INF])
    assert same(column(), [None] * 4)


def test_ties_are_rounded_in_floating_point(spark):
    """288.15 / 32 - 1 is a little less than 8.0046875, which is its shortest form."""
    df = spark.createDataFrame([(1, 288.15 / 32 - 1), (2, INF), (3, math.nan), (4, None), (5, -0.0000001), (6, 1e305)], "i int, x double")
    assert same([r.x for r in rounded(df, "i").orderBy("i").collect()], [round((288.15 / 32 - 1) * 1e6) / 1e6, INF, math.nan, None, 0.0, 1e305])
    assert (288.15 / 32 - 1) * 1e6 < 8004687.5 and repr(288.15 / 32 - 1) == "8.0046875"


def test_bursts_over_a_zero_are_held_at_five(spark):
    df = series(spark, [1, 2, 0, 4, 5, 6, 7, 8, 9])
    got = [r.burst for r in windows.drift_burst(df, "v", ["k"], ["t"], 2, 2, zeros=True).orderBy("t").collect()]
    assert got[:3] == [0.0] * 3 and got[3:6] == [5.0] * 3 and all(g < 5 or g == 5 for g in got[6:])
    assert [r.burst for r in windows.drift_burst(df, "v", ["k"], ["t"], 2, 2).orderBy("t").collect()][3:6] == [0.0] * 3


def test_paths_over_a_zero(spark):
    df = series(spark, [1, 2, 0, 4, 4, 4, 4])
    got = {r.t: r for r in windows.signature(df, "v", ["k"], ["t"], 3, zeros=True).collect()}
    assert same([got[t].s1_1 for t in range(3, 7)], [math.nan, INF, 0.0, 0.0]) and same([got[t].s2_1_1 for t in range(3, 6)], [INF, INF, 0.0])
    assert same([got[t].s1_0 for t in range(3, 7)], [1.0] * 4)


def test_variance_over_a_zero(spark):
    """Blocks of three steps of four rows weigh them by -1/4, 0 and 1/4, of two steps by -1/6 and 1/6."""
    df = series(spark, [1, 2, 0, 4, 4, 4, 4, 8, 8, 8])
    got = [r.pav_rv for r in labels.pre_averaged_variance(df, "v", ["k"], ["t"], 3, 6, zeros=True).orderBy("t").collect()]
    square = lambda a, b: (math.log(b) / 6 - math.log(a) / 6) ** 2
    # Row t takes the block of rows t - 5 to t - 3: at 6 steps 1 to 0 and 0 to 4, at 7 from 0 up alone.
    assert same(got, [None] * 6 + [INF, INF, square(1, 1), square(1, 1)])
    assert [r.pav_rv for r in labels.pre_averaged_variance(df, "v", ["k"], ["t"], 3, 6).orderBy("t").collect()][6:8] == [None, None]


def test_returns_of_labels_from_a_zero(spark):
    df = spark.createDataFrame([("a", i, float(v), 0.1) for i, v in enumerate([2, 0, 0, 3])], "k string, t int, v double, s double")
    got = labels.triple_barrier(df, "v", "s", ["k"], ["t"], 2.0, 1.5, 2, zeros=True).orderBy("t").collect()
    assert same([r.ret for r in got], [-1.0, math.nan, INF, None]) and [r.t_hit for r in got] == [1, 2, 3, None]

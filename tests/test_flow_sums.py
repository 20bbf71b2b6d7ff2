"""Decayed sums by buckets against a plain loop, and the engine without a frame of rows a row."""

import numpy as np

from marlstone.operators import decay


def test_decayed_sums_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 5 == 0 else "ab"[i % 2], i, None if i % 7 < 2 else float(rng.normal()), None if i % 7 < 2 else float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double").repartition(3)
    for keep in (0.95, 0.3):
        got = {r.t: (r.sx, r.sy) for r in decay.decayed_sums(df, {"sx": "x", "sy": "y"}, ["k"], ["t"], keep).collect()}
        state = {}
        for k, t, x, y in rows:
            a, b = state.get(k, (0.0, 0.0))
            if x is not None:
                a, b = keep * a + x, keep * b + y
            state[k] = (a, b)
            assert np.allclose(got[t], (a, b), rtol=1e-12, atol=1e-12)


def test_the_engine_collects_no_frame(spark):
    from marlstone.plans import research

    plan = research.flow_engine(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan

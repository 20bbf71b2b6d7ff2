"""What reads modes does not sift again, and gathers no row a series in the driver."""

import numpy as np

from marlstone.operators import modes


def test_missing_values_count_as_the_one_before():
    assert modes.known(np.array([np.nan, 1.0, np.inf, np.nan, 3.0])).tolist() == [0.0, 1.0, 1.0, 1.0, 3.0] and len(modes.known(np.empty(0))) == 0


def test_modes_are_worked_out_once(spark):
    v = np.sin(np.arange(60) / 3) + np.arange(60) / 20
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, t int, v double")
    plan = lambda found: found._jdf.queryExecution().toString()
    split = modes.mode_decomposition(df, "v", ["k"], ["t"], most=3)
    assert "whole(" not in plan(split)
    merged = modes.merged_modes(split, ["k"], ["t"])
    assert "ArrowEvalPython" not in plan(merged) and "SortMergeJoin" in plan(merged)
    assert np.isclose(sum(r.x for r in merged.collect()), v.sum())

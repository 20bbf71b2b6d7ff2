"""Folds are dealt once, not for each of their readers."""

from marlstone.operators import alpha


def test_forecasts_read_stored_folds(spark):
    rows = [("a", i, float((i * 7) % 11), 1 if (i * 7) % 11 > 5 else -1) for i in range(90)]
    found = alpha.out_of_fold(spark.createDataFrame(rows, "k string, t int, x double, y int"), ["x"], "y", ["k"], ["t"], 3, 2)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert len(got) == 90 and all((r.p_up > 0.5) == (r.label > 0) for r in got)

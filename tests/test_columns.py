"""Results of chunks as Arrow arrays, and the scan within a chunk."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.functions.columns import cut, joined
from marlstone.operators import chunks
from marlstone.operators.regimes import passes


def test_lists_are_cut_from_any_part_of_a_column():
    lists = pa.array([[1.0, None], [], [3.0], [4.0, 5.0]], pa.list_(pa.float64()))
    assert [x.tolist() for x in cut(lists.slice(2))] == [[3.0], [4.0, 5.0]]
    assert np.isnan(cut(lists)[0][1]) and len(cut(lists)) == 4


def test_results_keep_their_shape_and_nan_is_null():
    found = [{"a": np.array([1.0, np.nan]), "b": np.array([[1.0, 2.0], [np.nan, 4.0]]), "c": np.array([1, 2])}, {"a": np.empty(0), "b": np.empty((0, 2)), "c": np.empty(0, int)}, {"a": np.array([5.0]), "b": np.array([[5.0, 6.0]]), "c": np.array([3])}]
    kinds = {"a": "double", "b": "array<double>", "c": "int"}
    assert joined(found, kinds).to_pylist() == [{"a": [1.0, None], "b": [[1.0, 2.0], [None, 4.0]], "c": [1, 2]}, {"a": [], "b": [], "c": []}, {"a": [5.0], "b": [[5.0, 6.0]], "c": [3]}]
    assert len(joined([], kinds)) == 0


def test_passes_equal_a_loop():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 17, 100):
        steps, first, after = rng.random((n, 3, 3)), rng.random(3), rng.random(3)
        now, later = [first / first.sum()], [after]
        for s in steps:
            now.append(now[-1] @ s / (now[-1] @ s).sum())
        for s in steps[::-1]:
            later.append(s @ later[-1] / (s @ later[-1]).max())
        got = passes(steps, first, after)
        assert np.allclose(got[0], now) and np.allclose(got[1], later[::-1])


def test_a_worker_gets_a_share_of_the_rows(spark, monkeypatch):
    """However many rows the tasks that pack chunks have."""
    monkeypatch.setattr(chunks, "SHARE", 50)
    df = spark.range(1000).select(F.col("id").alias("t"), (F.col("id") % 200).alias("k"), F.col("id").cast("double").alias("v"))
    packed = chunks.Chunks(df, [F.col("v")], ["k"], ["t"])
    state = packed.step(None, lambda d, _: d.sum(0), lambda sums: sums)
    out = packed.rows_with(state, lambda d, s: {"total": d[:, 0] * 0 + s[0]}, {"total": "double"})
    assert out.rdd.getNumPartitions() >= 20 and out.count() == 1000 and {r.total for r in out.filter("k = 3").collect()} == {3 * 5 + 200.0 * 10}

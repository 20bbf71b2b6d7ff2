"""Bars and decayed flow over streams. In order, a stream gives what the batch operators give; later than the watermark, rows are dropped."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def ohlc_stream(df: DataFrame, value: str, keys: Sequence[str], time: str, order: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars per key: bar, open, high, low, close, n; a bar is final `late` after its end."""
    at = F.struct(time, order)
    rows = df.filter(F.col(value).isNotNull()).withWatermark(time, late)
    bars = rows.groupBy(*keys, F.window(time, every)).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("n"))
    return bars.select(*keys, F.col("window.start").alias("bar"), "open", "high", "low", "close", "n")


class DecayedFlow(StatefulProcessor):
    """Keeps, per key, one decayed sum per time constant and the last time; emits the mixture after each row."""

    def __init__(self, key_name: str, row_id: str, time: str, amount: str, taus: Sequence[float], weights: Sequence[float]):
        self.names, self.taus, self.weights = (key_name, row_id, time, amount), list(taus), list(weights)

    def init(self, handle) -> None:
        self.state = handle.getValueState("flow", "at double, sums array<double>")

    def handleInputRows(self, key, rows, timerValues):
        key_name, row_id, time, amount = self.names
        at, sums = self.state.get() if self.state.exists() else (None, [0.0] * len(self.taus))
        sums = list(sums)
        for pdf in [pd.concat(list(rows)).sort_values([time, row_id])]:
            out = []
            for t, q in zip(pdf[time], pdf[amount].fillna(0.0)):
                gap = 0.0 if at is None else max(0.0, t - at)  # rows out of order do not decay
                sums = [s * math.exp(-gap / tau) + q for s, tau in zip(sums, self.taus)]
                at = t if at is None else max(at, t)
                out.append(sum(w * s for w, s in zip(self.weights, sums)))
            self.state.update((float(at), sums))
            yield pd.DataFrame({key_name: key[0], row_id: pdf[row_id].to_numpy(), "flow": out})

    def close(self) -> None:
        pass


def decayed_flow_stream(df: DataFrame, time: str, amount: str, key: str, row_id: str, taus: Sequence[float], weights: Sequence[float]) -> DataFrame:
    """(key, row_id, flow) for each row, as operators.decay.decayed_flow gives on rows in order. `time` is in seconds. Needs the RocksDB state store."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{row_id}` {df.schema[row_id].dataType.simpleString()}, flow double"
    return df.groupBy(key).transformWithStateInPandas(DecayedFlow(key, row_id, time, amount, taus, weights), schema, "Append", "None")

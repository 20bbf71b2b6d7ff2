"""Calendars and streams."""

import pytest
from pyspark.sql import functions as F

from marlstone.sources import calendar
from marlstone.streaming import bars


def test_sessions_skip_weekends_and_follow_summer_time(spark):
    got = [str(r.ts) for r in calendar.sessions(spark, "2024-03-29", "2024-04-01", "09:00:00", "10:00:00", "1 hour").orderBy("ts").collect()]
    assert got == ["2024-03-29 08:00:00", "2024-03-29 09:00:00", "2024-04-01 07:00:00", "2024-04-01 08:00:00"]


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 2, m, float(m * m % 7)) for m in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "ts string, k long, id long, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    return df, lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), tmp_path


def test_stream_bars_equal_batch_bars(spark, stream):
    df, read, path = stream
    query = bars.ohlc_stream(read(), "v", ["k"], "ts", "id", "20 minutes", "1 minute").writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("bars").collect()}
    at = F.struct("ts", "id")
    want = df.groupBy("k", F.window("ts", "20 minutes").start.alias("bar")).agg(F.min_by("v", at), F.max("v"), F.min("v"), F.max_by("v", at), F.count("*"))
    assert got == {tuple(r) for r in want.collect()}


def test_stream_flow_equals_batch_flow(spark, stream):
    from marlstone.operators.decay import decayed_flow

    df, read, path = stream
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.unix_seconds("ts").cast("double")
    source = read().select("k", "id", at.alias("at"), "v")
    try:
        query = bars.decayed_flow_stream(source, "at", "v", "k", "id", [300.0, 60.0], [1.0, 0.5]).writeStream.format("memory").queryName("flow").option("checkpointLocation", str(path / "f")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.id: r.flow for r in spark.table("flow").collect()}
    want = {r.id: r.flow for r in decayed_flow(df.select("k", "id", at.alias("at"), "v"), "at", "v", ["k"], "id", [300.0, 60.0], [1.0, 0.5]).collect()}
    assert got == pytest.approx(want)

"""Queries of the series operators over whole tables, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import series as S

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def rolling_zscore(spark, sf_dir):
    return S.rolling(events(spark, sf_dir), "value", KEYS, ORDER, 20, 5).select("event_id", "mean", "sd", "zscore")


def ohlc_bars(spark, sf_dir):
    return S.ohlc(events(spark, sf_dir), "value", ["event_type"], "ts", "event_id", "hour")


def as_of_join(spark, sf_dir):
    rows = events(spark, sf_dir)
    clicks, rest = rows.filter("event_type = 'click'"), rows.filter("event_type != 'click'")
    found = S.as_of(clicks.select("event_id", "user_id", "ts"), rest.withColumnsRenamed({"event_id": "id"}).select("id", "user_id", "ts", F.col("value").alias("last_value"), F.col("event_type").alias("last_type")).withColumn("event_id", F.col("id")), KEYS, "ts", "event_id", ["last_value", "last_type"])
    return found.select("event_id", "last_value", "last_type")


def strength_index(spark, sf_dir):
    return S.strength_index(events(spark, sf_dir), "value", KEYS, ORDER).select("event_id", "rsi")


def rolling_line(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return S.rolling_line(rows, "l_quantity", "l_extendedprice", ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], 10).select("l_orderkey", "l_linenumber", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def barrier_labels(spark, sf_dir):
    return S.first_barrier(events(spark, sf_dir), "value", KEYS, ORDER, 10, 0.5, 0.5).select("event_id", "label")


def winsorized(spark, sf_dir):
    return S.winsorize(events(spark, sf_dir), "value", ["event_type"], 0.05, 0.95).select("event_id", "clipped")


def rank_correlation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_quantity", "l_discount")
    return S.rank_correlation(rows, "l_quantity", "l_discount", ["day"])


def volume_bars(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return S.volume_bars(rows, "l_extendedprice", "l_quantity", ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], 100.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (rolling_zscore, ohlc_bars, as_of_join, strength_index, rolling_line, barrier_labels, winsorized, rank_correlation, volume_bars)}

W = "PARTITION BY user_id ORDER BY ts, event_id"
SQL = {
    "rolling_zscore": f"""
SELECT event_id, mean, sd, CASE WHEN sd > 1e-9 THEN (value - mean) / sd END AS zscore FROM (
  SELECT event_id, value, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS mean, CASE WHEN count(value) OVER w >= 5 THEN stddev_samp(value) OVER w END AS sd
  FROM events WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    "ohlc_bars": """
SELECT event_type, date_trunc('hour', ts) AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    "as_of_join": """
WITH r AS (SELECT user_id, ts, arg_max(value, event_id) AS last_value, arg_max(event_type, event_id) AS last_type FROM events WHERE event_type != 'click' GROUP BY ALL)
SELECT event_id, last_value, last_type FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "strength_index": f"""
SELECT event_id, 100 * sum(greatest(c, 0)) OVER w / nullif(sum(greatest(c, 0)) OVER w + sum(greatest(-c, 0)) OVER w, 0) AS rsi
FROM (SELECT *, coalesce(value - lag(value) OVER ({W}), 0) AS c FROM events) WINDOW w AS ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "rolling_line": """
SELECT l_orderkey, l_linenumber, round(s, 4) AS slope, round(my - s * mx, 4) AS intercept FROM (
  SELECT *, CASE WHEN n = 10 THEN (sxy / 10 - mx * my) / nullif(round(sxx / 10 - mx * mx, 12), 0) END AS s FROM (
    SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, avg(l_quantity) OVER w AS mx, avg(l_extendedprice) OVER w AS my, sum(l_quantity * l_extendedprice) OVER w AS sxy, sum(l_quantity * l_quantity) OVER w AS sxx
    FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)))""",
    "barrier_labels": f"""
SELECT event_id, CAST(CASE WHEN g >= 0.5 THEN 1 WHEN g <= -0.5 THEN -1 ELSE 0 END AS INTEGER) AS label FROM (
  SELECT event_id, list_filter(list_transform(list(value) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), lambda v: v / nullif(value, 0) - 1), lambda g: g >= 0.5 OR g <= -0.5)[1] AS g FROM events)""",
    "winsorized": """
SELECT event_id, least(greatest(value, lo), hi) AS clipped FROM events JOIN (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1) USING (event_type)""",
    "rank_correlation": """
SELECT day, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(x, y) END AS ic FROM (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, rank() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_quantity) + (count(*) OVER (PARTITION BY CAST(l_shipdate AS DATE), l_quantity) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_discount) + (count(*) OVER (PARTITION BY CAST(l_shipdate AS DATE), l_discount) - 1) / 2.0 AS y
  FROM lineitem) GROUP BY day""",
    "volume_bars": """
SELECT l_suppkey, CAST(bar AS BIGINT) AS bar, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_quantity, l_extendedprice)) AS open, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_quantity, l_extendedprice)) AS close,
  sum(l_extendedprice * l_quantity) / sum(l_quantity) AS vwap, sum(l_quantity) AS quantity
FROM (SELECT *, floor((sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) - l_quantity) / 100) AS bar FROM lineitem) GROUP BY l_suppkey, bar""",
}

"""Session calendars, made by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(spark: SparkSession, first: str, last: str, begin: str = "09:00:00", end: str = "17:30:00", every: str = "1 second", zone: str = "Europe/Paris", weekdays: bool = True) -> DataFrame:
    """Instants (UTC, without zone) from `begin` to `end` local time of each day from first to last, both ends included; Monday to Friday only with weekdays. Holidays are not known."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    if weekdays:
        days = days.filter(~F.dayofweek("day").isin(1, 7))
    local = lambda clock: F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(f" {clock}")).cast("timestamp_ntz")
    grid = days.repartition("day").select(F.explode(F.sequence(local(begin), local(end), F.expr(f"INTERVAL {every}"))).alias("local"))
    return grid.select(F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("local")).alias("ts"))

"""Running totals, row numbers, ranks and quantiles of series too long for one task.

Rows are dealt to ranges of their order; each range adds up on its own, and what lies before it comes from the totals of the
ranges. There are as many totals a series as ranges, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.stored import stored

#: Rows a range at most, about.
RANGE = 1_000_000


def share_of(df: DataFrame) -> int:
    """Partitions for all rows of df, RANGE at most in each on average: what a task holds does not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / RANGE))


def running_total(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """Adds `into`: the sum of `value` over the rows of the key up to and with this one, in the order of `order` (which tells the rows of a key apart). Columns of df named like `into` are replaced. Null keys are a key; null values count 0."""
    ranges = share_of(df)
    keyed = [f"key_{i}" for i in range(len(keys))]
    rows = df.drop(into).select(F.struct("*").alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, keyed)], F.struct(*order).alias("at"), F.coalesce(value, F.lit(0)).alias("v"))
    placed = stored(rows.repartitionByRange(ranges, *keyed, "at").withColumn("part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*keyed, "part").agg(F.sum("v").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*keyed).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*[F.col(k).alias(f"own_{k}") for k in keyed], F.col("part").alias("own_part"), before.alias("start"))
    within = F.sum("v").over(Window.partitionBy(*keyed, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keyed]
    joined = placed.withColumn("within", within).join(starts, [*same, F.col("part") == F.col("own_part")])
    return joined.select("row.*", (F.col("start") + F.col("within")).alias(into))


def lagged(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """Adds `into`: the value of the row before, as F.lag over a window of the key. A range's first row of a key takes it from the last one of the range before. Null keys are a key."""
    keyed = [f"key_{i}" for i in range(len(keys))]
    rows = df.drop(into).select(F.struct("*").alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, keyed)], F.struct(*order).alias("at"), F.struct(F.col(value).alias("x")).alias("v"))
    placed = stored(rows.repartitionByRange(share_of(df), *keyed, "at").withColumn("part", F.spark_partition_id()), "ranges")
    ends = placed.groupBy(*keyed, "part").agg(F.max_by("v", "at").alias("end"))
    come = F.lag("end").over(Window.partitionBy(*keyed).orderBy("part"))
    starts = ends.select(*[F.col(k).alias(f"own_{k}") for k in keyed], F.col("part").alias("own_part"), come.alias("come"))
    within = F.lag("v").over(Window.partitionBy(*keyed, "part").orderBy("at"))
    same = [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keyed]
    found = placed.withColumn("within", within).join(starts, [*same, F.col("part") == F.col("own_part")])
    return found.select("row.*", F.coalesce("within", "come")["x"].alias(into))


def neighbours(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], into: dict[str, int]) -> DataFrame:
    """Adds a column for each of `into` (name: offset): the value so many rows ahead, or before if the offset is negative, as F.lead and F.lag over a window of the key. What lies beyond a range comes from the rows at the ends of the ranges next to it. Null keys are a key."""
    most = max(map(abs, into.values()))
    keyed = [f"key_{i}" for i in range(len(keys))]
    rows = df.drop(*into).select(F.struct("*").alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, keyed)], F.struct(*order).alias("at"), F.struct(F.col(value).alias("x")).alias("v"))
    placed = stored(rows.repartitionByRange(share_of(df), *keyed, "at").withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy(*keyed, "part").orderBy("at")
    held = placed.withColumns({"i": F.row_number().over(w)} | {f"l{k}": F.lag("v", k).over(w) for k in range(1, most + 1)} | {f"r{k}": F.lead("v", k).over(w) for k in range(1, most + 1)})
    # The last `most` rows of a range lie in its last row's lags, the first ones in its first row's leads. A range that holds a key has a row of it, so `most` ranges on a side are enough.
    last = F.array(*[F.col(f"l{k}") for k in range(most - 1, 0, -1)], F.col("v"))
    first = F.array(F.col("v"), *[F.col(f"r{k}") for k in range(1, most)])
    ends = held.groupBy(*keyed, "part").agg(F.max_by(last, "at").alias("last"), F.min_by(first, "at").alias("first"), F.count("*").alias("n"))
    w_part = Window.partitionBy(*keyed).orderBy("part")
    near = lambda c, a, b: F.filter(F.flatten(F.collect_list(c).over(w_part.rowsBetween(a, b))), lambda v: v.isNotNull())
    starts = ends.select(*[F.col(k).alias(f"own_{k}") for k in keyed], F.col("part").alias("own_part"), "n", near("last", -most, -1).alias("come"), near("first", 1, most).alias("go"))
    same = [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keyed]
    found = held.join(starts, [*same, F.col("part") == F.col("own_part")])
    back = lambda k: F.when(F.col("i") > k, F.col(f"l{k}")).otherwise(F.try_element_at("come", (F.col("i") - 1 - k).cast("int")))
    ahead = lambda k: F.when(F.col("i") + k <= F.col("n"), F.col(f"r{k}")).otherwise(F.try_element_at("go", (F.col("i") + k - F.col("n")).cast("int")))
    return found.select("row.*", *[(ahead(k) if k > 0 else back(-k))["x"].alias(c) for c, k in into.items()])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "i") -> DataFrame:
    """Adds `into`: 1, 2, ... in the order of `order` within each key."""
    return running_total(df, F.lit(1).cast("long"), keys, order, into)


def value_ranks(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """One row a key and distinct value, nulls left out: keys, value, n (how often it occurs), upto (how many rows of the key are not above it). Repeats are counted before they are dealt out, so a value that a third of all rows hold is one row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running_total(counts, F.col("n"), keys, [value], "upto")


def rank_moments(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Per group of `by`: n, and sxx, syy and sxy, the sums of squares and products of the average ranks about their mean, (n + 1) / 2, over the rows with both. Equal pairs are counted first; ranks come from counted values."""
    keyed = [f"by_{i}" for i in range(len(by))]
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(by, keyed)], F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = stored(both.groupBy(*keyed, "x", "y").agg(F.count("*").alias("c")), "pairs")
    sizes = pairs.groupBy(*keyed).agg(F.sum("c").alias("n"))
    same = lambda own: [F.col(k).eqNullSafe(F.col(f"{own}_{k}")) for k in keyed]
    named = lambda own: [F.col(k).alias(f"{own}_{k}") for k in keyed]
    ranked = pairs.join(F.broadcast(sizes.select(*named("all"), "n")), same("all")) if keyed else pairs.crossJoin(sizes)
    for c in ("x", "y"):
        upto = running_total(pairs.groupBy(*keyed, c).agg(F.sum("c").alias("held")), F.col("held"), keyed, [c], "upto")
        rank = upto.select(*named(c), F.col(c).alias(f"{c}_value"), (F.col("upto") - (F.col("held") - 1) / 2).alias(f"{c}_rank"))
        ranked = ranked.join(rank, [*same(c), F.col(c) == F.col(f"{c}_value")]).withColumn(f"{c}_off", F.col(f"{c}_rank") - (F.col("n") + 1) / 2)
    sums = {name: F.sum(F.col("c") * F.col(f"{a}_off") * F.col(f"{b}_off")).alias(name) for name, a, b in (("sxx", "x", "x"), ("syy", "y", "y"), ("sxy", "x", "y"))}
    found = ranked.groupBy(*keyed).agg(F.sum("c").alias("n"), *sums.values())
    return found.select(*[F.col(n).alias(k) for k, n in zip(by, keyed)], "n", *sums)


def exact_quantiles(df: DataFrame, value: str, keys: Sequence[str], at: Sequence[float], into: str = "q") -> DataFrame:
    """Per key: `into`, the array of the exact quantiles at `at`, linear between neighbours. A key without values has no row."""
    ranks = value_ranks(df, value, keys)
    n = F.max("upto").alias("_n")
    total = ranks.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(n)
    rows = ranks.join(total, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else ranks.withColumn("_n", F.lit(total.first()[0]))
    # Of sorted places 0 to n - 1, the one at p * (n - 1) lies between two; a value holds places upto - n to upto - 1.
    held = lambda place: (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
    out = []
    for p in at:
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low, part = F.floor(place), place - F.floor(place)
        a, b = F.max(F.when(held(low), F.col(value).cast("double"))), F.max(F.when(held(F.least(low + 1, F.col("_n") - 1)), F.col(value).cast("double")))
        out.append(a + (b - a) * F.max(part))
    return rows.groupBy(*keys).agg(F.array(*out).alias(into))


def with_quantiles(df: DataFrame, value: str, keys: Sequence[str], at: Sequence[float], into: str = "_q") -> DataFrame:
    """df with `into`, the array of exact_quantiles() of the row's key; null for a key without values. Null keys are a key."""
    found = exact_quantiles(df, value, keys, at, into)
    found = found.select(*[F.col(k).alias(f"_own_{i}") for i, k in enumerate(keys)], into)
    if not keys:
        return df.withColumn(into, F.lit(found.first()[0]))
    return df.join(found, [F.col(k).eqNullSafe(F.col(f"_own_{i}")) for i, k in enumerate(keys)], "left").drop(*[f"_own_{i}" for i in range(len(keys))])

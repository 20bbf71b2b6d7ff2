"""Long recursions over ordered series, spread over many tasks: a scan in two levels.

A series is cut into chunks of about the square root of all rows. What a chunk does to the state of a recursion is summed
up in a few numbers (a matrix, a Gaussian, a table of states), worked out for every chunk on its own. A second, small
pass goes over the chunks of a series in order and composes these, which gives each chunk the state that it begins with,
and, where needed, what follows it. A third pass works out the rows. No task holds more than a chunk's rows or the
summaries of a series' chunks, both of the order of the square root of the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import cut, joined
from marlstone.functions.stored import remove, stored

#: Rows a chunk at least, so that small tables are not cut to pieces, and rows a range of the sorted input at most.
LEAST, RANGE = 2048, 1_000_000
#: Rows about whose results a worker holds at once: these come to many numbers a row.
SHARE = 250_000

Local = Callable[..., np.ndarray]
Across = Callable[[list[np.ndarray]], list[np.ndarray]]


class Chunks:
    """The rows of df, per `keys` and in the order of `order` (its last column unique in a series), cut into chunks of `rows`.

    numbers: the columns that the recursion reads, as doubles, null as NaN. Columns of df must be orderable (no maps). df is
    read three times, to count, to find the ranges and to pack it; it should be cheap to read. A null key is a series.
    """

    def __init__(self, df: DataFrame, numbers: Sequence[Column], keys: Sequence[str], order: Sequence[str], rows: int | None = None):
        total = df.count()
        self.columns, self.width, self.shares = df.columns, len(numbers), max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))
        self.keys = [f"key_{i}" for i in range(len(keys))]
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
        size = rows or max(LEAST, math.isqrt(total))
        value = F.array(*[F.coalesce(c.cast("double"), F.lit(math.nan)) for c in numbers])
        named = df.select(*[F.col(k).alias(n) for k, n in zip(keys, self.keys)], F.struct(*order).alias("at"), value.alias("v"), F.struct("*").alias("row"))
        placed = named.repartitionByRange(ranges, *self.keys, "at").withColumn("part", F.spark_partition_id())
        within = F.row_number().over(Window.partitionBy(*self.keys, "part").orderBy("at")) - 1
        placed = placed.withColumn("piece", F.floor(within / size))
        packed = placed.groupBy(*self.keys, "part", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "v", "row"))).alias("items"))
        # Ranges of a long series are few: unless its chunks are dealt out, few tasks do every pass, with all rows of a range each.
        packed = packed.repartition(self.shares, *self.keys, "part", "piece")
        self.packed = stored(
            packed.select(F.monotonically_increasing_id().alias("chunk"), *self.keys, F.struct("part", "piece").alias("place"), F.size("items").alias("n"), F.flatten(F.transform("items", lambda x: x["v"])).alias("data"), F.transform("items", lambda x: x["row"]).alias("rows")), "chunks"
        )

    def parted(self, most: int) -> tuple[DataFrame, DataFrame]:
        """(chunk, s) with an empty s for the chunks of series of at most `most` rows, and for those of longer ones."""
        sizes = self.packed.select("chunk", F.sum("n").over(Window.partitionBy(*self.keys)).alias("all"), F.array().cast("array<double>").alias("s"))
        return tuple(stored(sizes.filter(c).drop("all"), "scan") for c in (F.col("all") <= most, F.col("all") > most))

    def whole(self, state: DataFrame, local: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
        """(chunk, s) of the chunks of `state`, which has all those of a series or none: local(matrices of the numbers of some series) gives each its s. A series lies in one row meanwhile. `state` goes."""
        width = self.width

        def results(data: pd.Series) -> pd.Series:
            return pd.Series([x.tolist() for x in local([np.asarray(d).reshape(-1, width) for d in data])], dtype=object)

        rows = self.packed.select("chunk", *self.keys, "place", "data").join(state.select("chunk"), "chunk")
        series = rows.groupBy(*self.keys).agg(F.sort_array(F.collect_list(F.struct("place", "chunk", "data"))).alias("all"))
        series = series.select(F.transform("all", lambda x: x["chunk"]).alias("chunks"), F.flatten(F.transform("all", lambda x: x["data"])).alias("data"))
        found = series.select("chunks", F.pandas_udf(results, "array<double>")("data").alias("s"))
        out = stored(found.select(F.explode("chunks").alias("chunk"), "s"), "scan")
        remove(state)
        return out

    def step(self, state: DataFrame | None, local: Local, across: Across, few: bool = False) -> DataFrame:
        """(chunk, s): local(matrix of a chunk's numbers, its s) sums up each chunk; across(the sums of a series' chunks, in order) gives each its next s. `state` goes, as it is no longer read. With `few` it goes to all tasks, so that no chunk is shuffled; chunks that it lacks are left out."""
        width = self.width

        def sums(data: pd.Series, before: pd.Series) -> pd.Series:
            return pd.Series([local(np.asarray(d).reshape(-1, width), np.asarray(s)).tolist() for d, s in zip(data, before)], dtype=object)

        def along(series: pd.Series) -> pd.Series:
            return pd.Series([[x.tolist() for x in across([np.asarray(s) for s in sums])] for sums in series], dtype=object)

        rows = self.packed.select("chunk", *self.keys, "place", "data")
        rows = rows.withColumn("before", F.array().cast("array<double>")) if state is None else rows.join((F.broadcast if few else lambda x: x)(state.withColumnRenamed("s", "before")), "chunk")
        found = rows.select("chunk", *self.keys, "place", F.pandas_udf(sums, "array<double>")("data", "before").alias("s"))
        series = found.groupBy(*self.keys).agg(F.sort_array(F.collect_list(F.struct("place", "chunk", "s"))).alias("all"))
        series = series.select(F.transform("all", lambda x: x["chunk"]).alias("chunk"), F.pandas_udf(along, "array<array<double>>")(F.transform("all", lambda x: x["s"])).alias("s"))
        out = stored(series.select(F.explode(F.arrays_zip("chunk", "s")).alias("one")).select("one.*"), "scan")
        if state is not None:
            remove(state)
        return out

    def rows_with(self, state: DataFrame, local: Callable[..., dict[str, np.ndarray]], added: dict[str, str]) -> DataFrame:
        """The rows of df with the columns of `added` (name: type, in place of columns of these names) from local(matrix, s) -> {name: a value a row}."""
        width = self.width
        kind = ", ".join(f"`{n}` array<{t}>" for n, t in added.items())

        def values(data: pa.Array, s: pa.Array) -> pa.Array:
            return joined([local(d.reshape(-1, width), x) for d, x in zip(cut(data), cut(s))], added)

        dealt = self.packed.select("chunk", "data", "rows").repartition(self.shares, "chunk").join(state.repartition(self.shares, "chunk"), "chunk")
        rows = dealt.select("rows", F.arrow_udf(values, f"struct<{kind}>")("data", "s").alias("_new"))
        rows = rows.select("rows", "_new.*") if "rows" not in added else rows.select("rows", *[F.col(f"_new.{n}").alias(n) for n in added])
        one = rows.select(F.explode(F.arrays_zip("rows", *added)).alias("one"))
        return one.select(*[F.col(f"one.rows.`{c}`") for c in self.columns if c not in added], *[F.col(f"one.`{n}`") for n in added])


def unpack(s: np.ndarray, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    """Cuts a vector into arrays of these shapes; () is a single number."""
    out, at = [], 0
    for shape in shapes:
        n = math.prod(shape)
        out.append(s[at : at + n].reshape(shape) if shape else s[at])
        at += n
    return out


def pack(*parts) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in parts]).astype(float)


def reduced(elements: tuple[np.ndarray, ...], combine) -> tuple[np.ndarray, ...]:
    """The product of a chain of elements (arrays with a first axis over the chain), neighbours combined in pairs, level by level."""
    while len(elements[0]) > 1:
        n = len(elements[0]) // 2 * 2
        pairs = combine(tuple(x[0:n:2] for x in elements), tuple(x[1:n:2] for x in elements))
        elements = tuple(np.concatenate([p, x[n:]]) for p, x in zip(pairs, elements))
    return elements

"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The mix is a sequence of slots of `block_words` words each. Slot i falls on the point frac(i * golden ratio),
which the sources' cumulative target shares map to a source; the ranks of a source's slots number the blocks
that it hands out. A source's documents, shuffled by a hash of their key, lie end to end on a line that repeats
up to `max_repeats` times and is cut into blocks of equal length; a document's share of the mix is what the
blocks handed out cover of it.

Ranks and positions come from two-level prefix sums (totals of chunks, then positions within a chunk), so no
task holds all slots or all documents of a source. Only the table of sources, one row each, is in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import WORD, store

GOLDEN = (math.sqrt(5) - 1) / 2
CHUNK = 8192


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=(5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Per source: rank (by code point, null last), source_size, weight, target.

    Weights repeat over the ranks and share all words; a target stops at max_repeats times the source's size and
    what is over goes to the others by weight. With the sources sorted by cap / weight, the rate that is left after
    capping the first i of them rises until the last one that must be capped and then falls, so the rate is its maximum.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    k = F.pmod(F.col("rank"), F.lit(len(weights))) + 1
    total, left_w = F.sum("source_size").over(every), F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), k.cast("int")))
        .withColumn("cap", max_repeats * F.col("source_size").cast("double"))
        .withColumns({"total": total.cast("double"), "left_w": left_w})
        .withColumn("lead", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("left_w"))
        .withColumn("target", F.least("cap", F.col("weight") * F.max("lead").over(every)))
        .withColumn("upto", F.sum("target").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
        .select("source", "rank", "source_size", "target", "total", (F.col("upto") - F.col("target")).alias("lo"), F.col("upto").alias("hi"))
    )


def mix_sources(docs: DataFrame, *, key="doc_id", text="text", source="source", weights=(5, 2, 1), max_repeats=3, block_words=32, seed=7) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, taken.

    size: words of the text (null or empty: 0, never taken). A null source is a source of its own, the last one. Columns
    of docs other than the three named are ignored, whatever their names. Repeated rows are documents of their own:
    of equal rows each gets its own place on the line, and which of them gets which is not told apart. An empty
    table gives an empty result. taken is at most max_repeats * size; reruns agree.
    """
    spark = docs.sparkSession
    point = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 8), 16, 10).cast("long")
    sized = store(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), point.alias("point")), "mix-sizes")
    sources = store(source_targets(sized, weights, max_repeats), "mix-sources")
    n_docs, n_sources, words = (sized.count(), *sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first())

    taken = _slots(spark, sources, n_sources, -(-words // block_words))
    line = _lines(sized, sources, max(1, -(-n_docs // CHUNK)))
    reach = taken.groupBy("rank").agg((F.max("block") + 1).alias("n_blocks"))
    most = F.least(F.coalesce("n_blocks", F.lit(0)) * block_words, max_repeats * F.col("source_size"))
    turns = F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("most"), F.col("source_size"))).cast("int"))
    placed = (
        line.join(reach, "rank", "left").withColumn("most", most)
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.coalesce(turns, F.lit(1)) - 1)))
        .withColumn("begin", F.col("turn") * F.col("source_size") + F.col("place"))
        .withColumn("end", F.least(F.col("begin") + F.col("size"), "most"))
        .withColumn("block", F.explode_outer(F.when(F.col("end") > F.col("begin"), F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words)))))
    )
    covered = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("begin", F.col("block") * block_words)
    return (
        placed.join(taken.withColumn("hit", F.lit(True)), ["rank", "block"], "left")
        .groupBy("rank", "place", "key", "source", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.when(F.col("hit"), covered)), F.lit(0)).cast("long").alias("taken"), F.max("copies").alias("copies"))
        .withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken")
    )


def _slots(spark, sources: DataFrame, n_sources: int, n_slots: int) -> DataFrame:
    """(rank, block): the slots of each source, numbered in the order of the schedule."""
    cells = max(1, 4 * n_sources)
    ranges = (
        sources.filter("hi > lo").withColumns({"lo": F.col("lo") / F.col("total"), "hi": F.col("hi") / F.col("total")})
        .withColumn("hi", F.when(F.col("rank") == F.max("rank").over(Window.partitionBy()), F.lit(2.0)).otherwise(F.col("hi")))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least("hi", F.lit(1.0)) * cells))))
        .select("rank", "lo", "hi", "cell")
    )
    turn = F.col("id") * F.lit(GOLDEN)
    slots = (
        spark.range(n_slots).withColumn("u", turn - F.floor(turn)).withColumn("cell", F.floor(F.col("u") * cells))
        .join(ranges, "cell").filter("u >= lo AND u < hi").select("rank", "id", (F.col("id") / CHUNK).cast("long").alias("chunk"))
    )
    totals = slots.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("rank", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("id"))
    return store(slots.withColumn("within", within).join(starts, ["rank", "chunk"]).select("rank", (F.col("start") + F.col("within") - 1).alias("block")), "mix-slots")


def _lines(sized: DataFrame, sources: DataFrame, chunks: int) -> DataFrame:
    """Places the documents of each source end to end, in the order of their points. Rows alike in key, source and size form one row with a number of copies if they are empty."""
    named = sized.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name", "lo", "hi", "total")
    chunk = F.floor(F.col("point") * F.lit(chunks) / F.lit(2.0**32)).cast("long")
    empty = F.col("size") == 0
    named = (
        named.withColumn("chunk", chunk).filter(~empty).withColumn("copies", F.lit(1))
        .unionByName(named.filter(empty).groupBy(*named.columns).agg(F.count("*").cast("int").alias("copies")).withColumn("chunk", chunk))
    )
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = named.groupBy("rank", "chunk").agg(F.sum("size").alias("n")).select("rank", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.sum("size").over(Window.partitionBy("rank", "chunk").orderBy("point", "key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return named.withColumn("within", within).join(starts, ["rank", "chunk"]).withColumn("place", F.col("start") + F.col("within")).drop("chunk", "point", "start", "within")

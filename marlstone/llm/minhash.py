"""Near-duplicate groups by one-permutation MinHash with optimal densification.

A document's distinct shingles are hashed once; the hash's high part names a bin and each bin keeps its least hash. An
empty bin borrows from the first filled one of its probes, an order of all bins that a hash of (bin, attempt) gives, the
same for every document; so every empty bin of a set with a shingle finds one. Bins form bands, bands form buckets. Documents with equal sets are one node. In a bucket only star edges are made, from a
centre that a hash picks, so that a group's many buckets have different centres; they are confirmed on the full sets,
and the links' components are taken. In buckets that hold several components the nodes are then compared block by block,
across components only, so no link between bucket mates is lost.

Before two full sets are compared, a bound on their difference is: every node keeps the parities of BITS counts of its
hashes, and parities that differ are no more than the shingles that only one of both has. This loses no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import HASHES, remove, store, words_of

BANDS, ROWS = 32, 6
#: Parities of a set, 64 to a word.
BITS = 1024
#: Nodes of an unsettled bucket in one block; two blocks meet in one task.
BLOCK = 512
#: Partners of a centre that are compared with one copy of its set.
PARTNERS = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of `width` consecutive words; of all words if there are fewer; none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = _mixed(out * MIX + h[j : j + len(out)])
    return np.unique(out)


def probes(bins: int) -> np.ndarray:
    """Where bin i looks on attempt j, a permutation of all bins: the same for every document."""
    i = np.arange(bins, dtype=np.uint64)
    return np.argsort(_mixed(_mixed(i + np.uint64(1))[None, :] + i[:, None] * MIX), axis=0, kind="stable")


def sketch(h: np.ndarray, bands: int, rows: int, where: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    bins = bands * rows
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))  # h is sorted, and so are the bins
    least[at[first]] = h[first]
    full = np.zeros(bins, bool)
    full[at] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        tries = where[:, empty]
        least[empty] = least[tries[full[tries].argmax(axis=0), np.arange(len(empty))]]
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = _mixed(out * MIX + column)
    return out.view(np.int64)


def parities(h: np.ndarray) -> np.ndarray:
    """Of the number of hashes in each of BITS classes, as 64-bit words."""
    return np.packbits(np.bincount((h & np.uint64(BITS - 1)).view(np.int64), minlength=BITS) & 1).view(np.int64)


def sketches(width: int, bands: int, rows: int):
    where = probes(bands * rows)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, same, odd, buckets = [], [], [], []
            for text in texts:
                h = shingle_hashes(text, width)
                n.append(len(h))
                same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                odd.append(parities(h) if len(h) else None)
                buckets.append(sketch(h, bands, rows, where) if len(h) else None)
            yield pd.DataFrame({"n": n, "same": same, "odd": odd, "buckets": buckets})

    return run


def set_bytes(width: int):
    return lambda texts: texts.map(lambda t: shingle_hashes(t, width).tobytes())


def confirm(percent: int):
    """Whether two full sets, as sorted hashes, are linked."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for a, b in zip(left, right):
                shared = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                out.append(8 * 100 * shared >= percent * (len(a) + len(b) - 8 * shared))
            yield pd.Series(out, dtype=bool)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that links (a, b) reach, for every node that has a link.

    Alternates large stars (neighbours above a node move to its least neighbour) and small stars (those below), until
    the links are stars. Each round is written and reread.
    """
    spark = links.sparkSession
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = store(small.filter("a > b").distinct(), "links")
        remove(spark, edges)
        edges = after
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Rows of texts, of sets or of pairs of sets that a Python worker takes at once.
AT_ONCE = 1000


def near_duplicates(docs: DataFrame, *, key="doc_id", text="text", width=5, percent=80, bands=BANDS, rows=ROWS, keep_row=False) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the least key reachable over links), kept (key = component_id), first (one row of each group).

    Two rows are linked if 100 * |intersection| >= percent * |union| of their distinct `width`-word shingles. Null or
    empty texts have no set and no link: they are kept. Repeated rows are one group and those with the least key are
    all kept, but only one of them is `first`; ties between their rows go to the least place in the table. A null key is never a group's least unless all are null; such rows have
    component_id null and are kept if they are first. An empty table gives an empty result. Long texts are
    read whole. Other columns of docs, whatever their names, are ignored, or come along in the struct `row` with keep_row.
    """
    spark = docs.sparkSession
    prepare = F.pandas_udf(sketches(width, bands, rows), "struct<n long, same binary, odd array<long>, buckets array<long>>")
    row = F.struct("*") if keep_row else F.struct(F.col(key), F.col(text))
    table = store(docs.select(F.monotonically_increasing_id().alias("row_id"), row.alias("row"), F.col(key).alias("key"), prepare(F.col(text)).alias("s")), "sketches", AT_ONCE)
    flat = table.select("row_id", "key", "s.n", "s.same", "s.odd", "s.buckets")

    # Documents with equal sets: one node, named by its least row.
    alike = flat.filter("n > 0").groupBy("same").agg(F.min(F.struct("row_id", "n", "odd", "buckets")).alias("s"), F.min(F.struct(F.col("key").isNull(), "key", "row_id")).alias("least"))
    nodes = store(alike.select("same", F.col("s.row_id").alias("node"), "s.n", "s.odd", "s.buckets", "least"), "nodes")
    # A set so small that one more shingle is too many links with equal ones alone.
    members = nodes.filter(100 * F.col("n") >= percent * (F.col("n") + 1)).select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("bucket", "node"), "node")).alias("c")).filter("m > 1")
    mates = store(members.join(shared.select("bucket", "m", F.col("c.node").alias("centre")), "bucket"), "bucket-mates")
    some = mates.select("node").distinct()
    odd = store(nodes.select("node", "n", "odd").join(some, "node", "left_semi"), "parities")
    texts = table.select(F.col("row_id").alias("node"), F.col(f"row.`{text}`").alias("text")).join(some, "node", "left_semi")
    sets = store(texts.select("node", F.pandas_udf(set_bytes(width), "binary")("text").alias("set")), "mate-sets", AT_ONCE)
    check = F.pandas_udf(confirm(percent), "boolean")
    differing = sum((F.bit_count(F.col("a_odd")[i].bitwiseXOR(F.col("b_odd")[i])) for i in range(1, BITS // 64)), F.bit_count(F.col("a_odd")[0].bitwiseXOR(F.col("b_odd")[0])))
    close = (percent + 100) * differing <= (100 - percent) * (F.col("a_n") + F.col("b_n"))

    def named(rows: DataFrame, side: str) -> DataFrame:
        return rows.withColumnsRenamed({c: f"{side}_{c}" for c in rows.columns if c != "node"} | {"node": side})

    def confirmed(pairs: DataFrame) -> DataFrame:
        """A centre's partners are dealt in parts of PARTNERS, each with a copy of the centre's set."""
        pairs = store(pairs, "near-pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        copies = parts.join(named(sets, "a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
        links = store(dealt.join(copies.drop("parts"), ["a", "part"]).join(named(sets, "b"), "b").filter(check("a_set", "b_set")).select("a", "b"), "near-links", AT_ONCE)
        remove(spark, pairs)
        return links

    star = mates.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(star.join(named(odd, "a"), "a").join(named(odd, "b"), "b").filter(close).select("a", "b"))
    roots = store(components(links), "roots")

    placed = mates.select("bucket", "m", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
    blocks = F.ceil(F.col("m") / BLOCK)
    rest = store(placed.join(spread, "bucket").join(odd, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks)), "unsettled")
    cells = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left, right = named(cells.drop("m"), "a"), named(cells.drop("m"), "b")
    meet = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_block") == F.col("b_other")) & (F.col("a_other") == F.col("b_block"))
    pairs = left.join(right, meet & (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & close).select("a", "b").distinct()
    more = confirmed(pairs)
    if not more.isEmpty():
        roots = store(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")

    grouped = nodes.select("same", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("best"))
    by_set = grouped.join(least, "root").select("same", "best")
    same = F.coalesce("s.same", F.unhex(F.hex("row_id")))  # rows without words don't meet in one task
    out = table.select("row_id", "row", "key", "s.n", same.alias("same")).join(by_set, "same", "left")
    remove(spark, mates, odd, sets, rest)
    group = F.when(F.col("best").isNull(), F.col("key")).otherwise(F.col("best.key"))
    first = F.coalesce(F.col("best.row_id") == F.col("row_id"), F.lit(True))
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("key") == group, first).alias("kept"), first.alias("first"), *(["row"] if keep_row else [])
    )

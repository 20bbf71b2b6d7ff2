"""Benchmark decontamination by winnowed fingerprints.

Every run of `window` words that a document shares with an item must be found. The hash of each `gram` words is taken
and, in each sliding window of window - gram + 1 of them, the least is kept as fingerprint: a shared run holds such
a window whole on both sides and so shares its fingerprint. Items of fewer than `window` words are runs of their own
length; for these, documents are looked up by every hash of that length. Pairs that share a fingerprint are then
extended: the hashes of whole windows show where runs are shared, and the words themselves confirm it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import store

WINDOW, GRAM = 13, 5
#: Up to so many fingerprints of benchmark items (8 bytes each) go to all tasks, to drop the documents' other ones early; beyond it, all are shuffled.
LOCAL_FINGERPRINTS = 1_000_000
#: Up to so many characters of items, with no more fingerprints than that, are broadcast to the pairs.
LOCAL_CHARS = 1 << 25
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Turns A-Z to a-z and every other byte below 128 that is no digit or lower-case letter to a space.
TO_WORDS = bytes(b if b > 127 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * MULTIPLIER + h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= MULTIPLIER
    return out ^ (out >> np.uint64(29))


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """The distinct least hashes of all windows of w; none if there is no whole window."""
    n = len(g) - w + 1
    if n <= 0:
        return g[:0]
    least, have = g, 1
    while have < w:  # windows of `have` become windows of up to twice as many
        step = min(have, w - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return np.unique(least)


def fingerprints(h: np.ndarray, short: list[int], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Of a document: winnowed ones, and all of the lengths of short items, told apart by their length."""
    parts = [winnow(gram_hashes(h, gram), window - gram + 1), *(gram_hashes(h, k) ^ np.uint64(k) for k in short)]
    return np.unique(np.concatenate(parts))


def item_fingerprints(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    return winnow(gram_hashes(h, gram), window - gram + 1) if len(h) >= window else gram_hashes(h, len(h)) ^ np.uint64(len(h)) if len(h) else h


def shared_runs(words: list[bytes], h: np.ndarray, theirs: list[bytes], window: int) -> list[tuple[int, int]]:
    """The stretches [begin, end) of the document's words inside occurrences of windows of the item, apart from each other and in order."""
    size = min(window, len(theirs))
    out: list[tuple[int, int]] = []
    if size and len(words) >= size:
        windows = {b" ".join(theirs[i : i + size]) for i in range(len(theirs) - size + 1)}
        for i in np.flatnonzero(np.isin(gram_hashes(h, size), gram_hashes(word_hashes(theirs), size))).tolist():
            if b" ".join(words[i : i + size]) in windows:
                if out and i <= out[-1][1]:
                    out[-1] = (out[-1][0], i + size)
                else:
                    out.append((i, i + size))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, *, key="doc_id", text="text", item_key="item_id", item_text="text", window=WINDOW, gram=GRAM, keep_row=False, local_fingerprints=LOCAL_FINGERPRINTS) -> DataFrame:
    """Per row of docs: key, n_words, n_hit (words inside an occurrence of an item's window), n_items, items (their ids as strings, sorted), contaminated, and row_id, a number of its own.

    A row is contaminated if a word is hit and 20 * n_hit >= n_words. Null or empty texts have no words. Null item ids read
    'null'; equal ids count once. Repeated rows each give their row; there are no ties. An empty table of either kind hits nothing.
    Long texts are read whole. Other columns of either table are ignored, whatever their names. With keep_row, the row of docs comes along as the struct `row`.
    """
    spark = docs.sparkSession

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, fp = [], []
            for t in batch["text"]:
                h = word_hashes(item_words(t))
                n.append(len(h))
                fp.append(item_fingerprints(h, window, gram).view(np.int64))
            yield pd.DataFrame({"item": batch["item"], "text": batch["text"], "n": n, "fps": fp})

    named = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    theirs = named.mapInPandas(of_items, "item string, text string, n int, fps array<long>").filter("n > 0")
    theirs = store(theirs.withColumn("item_row", F.monotonically_increasing_id()), "items")
    short = sorted(r.n for r in theirs.filter(F.col("n") < window).select("n").distinct().collect())  # fewer than `window` numbers
    n_prints, n_chars = theirs.agg(F.coalesce(F.sum(F.size("fps")), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    small = lambda df: F.broadcast(df) if n_prints <= local_fingerprints and n_chars <= LOCAL_CHARS else df
    prints = theirs.select("item_row", F.explode("fps").alias("fp"))
    wanted = None
    if n_prints <= local_fingerprints:
        wanted = spark.sparkContext.broadcast(np.array(sorted(r.fp for r in prints.select("fp").distinct().collect()), np.int64))

    def of_docs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = wanted.value if wanted else None
        for batch in batches:
            n, fps = [], []
            for t in batch:
                words = item_words(t)
                n.append(len(words))
                fp = fingerprints(word_hashes(words), short, window, gram).view(np.int64)
                fps.append(fp if known is None else fp[np.isin(fp, known)])
            yield pd.DataFrame({"n_words": n, "fps": fps})

    found = F.pandas_udf(of_docs, "struct<n_words long, fps array<long>>")(F.col(text))
    row = F.struct("*") if keep_row else F.lit(None).cast("int")
    rows = store(docs.select(F.monotonically_increasing_id().alias("row_id"), row.alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), found.alias("found"))
                 .select("row_id", "row", "key", "found.*", F.when(F.size("found.fps") > 0, F.col("text")).alias("text")), "doc-fingerprints")
    marked = rows.filter(F.size("fps") > 0)
    pairs = marked.select("row_id", F.explode("fps").alias("fp")).join(small(prints), "fp").select("row_id", "item_row").distinct()

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = words = h = None
        for batch in batches:
            found = []
            for row, t, theirs in zip(batch["row_id"], batch["text"], batch["item_text"]):
                if row != last:  # a row's pairs mostly follow each other
                    words = item_words(t)
                    last, h = row, word_hashes(words)
                found.append([{"begin": x, "end": y} for x, y in shared_runs(words, h, item_words(theirs), window)])
            out = pd.DataFrame({"row_id": batch["row_id"], "item": batch["item"], "runs": found})
            yield out[out["runs"].map(len) > 0]

    # A pair carries numbers; its two texts join it once.
    with_items = pairs.join(small(theirs.select("item_row", "item", F.col("text").alias("item_text"))), "item_row")
    hits = with_items.join(marked.select("row_id", "text"), "row_id").select("row_id", "item", "text", "item_text")
    hits = hits.mapInPandas(extend, "row_id long, item string, runs array<struct<`begin` int, `end` int>>")
    runs = F.sort_array(F.flatten(F.collect_list("runs")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["begin"], a["upto"]))).alias("n"), F.greatest(a["upto"], r["end"]).alias("upto"))
    checked = hits.groupBy("row_id").agg(F.sort_array(F.collect_set("item")).alias("items"), F.aggregate(runs, start, step)["n"].cast("long").alias("n_hit"))
    out = rows.select("row_id", "key", "n_words", *(["row"] if keep_row else []))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.join(checked, "row_id", "left").select(
        "row_id", F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *(["row"] if keep_row else []),
    )


def items_digest(ids: list[str]) -> str:
    """What the query calls items_sha256, for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()

"""Quality selection by importance resampling over hashed n-grams.

Two generative models of n-grams are estimated: of the target, from good labelled documents, and of raw text, from all
documents. An n-gram is one or two words, counted once a document, or one to three shapes of tokens, as often as they
occur; each is hashed to a place. A model is the expected number of each place in as many n-grams as the target has, with
PRIOR more; places whose ratio is under FACTOR either way tell nothing. A document's log weight is log p_target - log p_raw,
summed over its n-grams: a rare word that good documents avoid counts as much in a long text as in a short one.
Documents are drawn without replacement, in proportion to their weights, by Gumbel top-k: the k rows of greatest
log weight + noise. By default k is how many rows weigh at least what all but SPARED of held-out good documents do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.decontaminate import gram_hashes, item_words
from marlstone.llm.shared import HASHES, store

#: Labelled documents that the target is fitted on, at most: the rows with the least hash.
MAX_LABELS = 10_000
#: Places of the hashed n-grams of words and of shapes. The table of log ratios, 8 bytes a place, goes to all tasks.
WORDS, SHAPED = 1 << 20, 1 << 16
BUCKETS = WORDS + SHAPED
#: How many n-grams each place of either model is given beforehand.
PRIOR = 1.0
#: How much likelier a place must be under one model than under the other to count.
FACTOR = 6.0
#: The share of held-out good documents that may weigh less than what is selected.
SPARED = 0.01
#: One labelled text of so many is kept from the fit.
HELD_OUT = 5
#: Tables of counts are handed on in pieces, and added up in two steps so that no task holds those of all tasks.
PIECES, LANES = 17, 256
#: Capital letters, small letters and bytes above 127, digits; the rest stand for themselves.
SHAPES = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b > 127 else 57 if 48 <= b <= 57 else b for b in range(256))
#: Which bytes part tokens.
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """The places of a text's n-grams: each of words once, those of shapes as often as they occur."""
    if not text:
        return np.zeros(0, np.int64)
    place = lambda h, size: (h * SPREAD >> np.uint64(65 - size.bit_length())).astype(np.int64)
    words = item_words(text)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    signs = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(SHAPES), np.uint8)
    alone = np.concatenate([[True], (signs[1:] != signs[:-1]) | BLANK[signs[1:]]])  # of a run of one sign, the first
    shapes = signs[alone].tobytes().split()
    s = np.fromiter(map(HASHES.__getitem__, shapes), np.uint64, len(shapes))
    of_shapes = np.concatenate([gram_hashes(s, k) + np.uint64(k) for k in (1, 2, 3)])
    return np.concatenate([np.unique(place(np.concatenate([h, gram_hashes(h, 2)]), WORDS)), WORDS + place(of_shapes, SHAPED)])


def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's counts, raw and of the target, in pieces of 4 bytes a count."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        shapes = ([], [])
        for text, target in zip(batch["text"], batch["target"]):
            places = grams(text)
            words = places[: np.searchsorted(places >= WORDS, True)]
            for kind in (0, 1) if target else (0,):
                counts[kind][words] += 1  # each once in a text
                shapes[kind].append(places[len(words) :] - WORDS)
        for kind, found in enumerate(shapes):
            if found:
                counts[kind][WORDS:] += np.bincount(np.concatenate(found), minlength=SHAPED).astype(np.int32)
    lane = TaskContext.get().partitionId() % LANES
    yield pd.DataFrame({"lane": lane, "piece": range(PIECES), "width": 4, "counts": [np.ascontiguousarray(x).tobytes() for x in np.split(counts, PIECES, axis=1)]})


def add_tables(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int32 if n == 4 else np.int64).astype(np.int64) for c, n in zip(group["counts"], group["width"]))
    return pd.DataFrame({"lane": group["lane"].iloc[:1], "piece": group["piece"].iloc[:1], "width": [8], "counts": [total.tobytes()]})


def some_labels(labels: DataFrame, most: int) -> DataFrame:
    """(label_key, known, harm), at most `most` rows: of several labels for an id the worst."""
    quality = (F.col("quality") == 1).cast("int")
    some = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_key")).agg(F.min(quality).alias("known"), F.max(F.coalesce("toxic", F.lit(0))).alias("harm"))
    return some.orderBy(F.xxhash64("label_key"), "label_key").limit(most)


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(text, known, good, held): every row of docs; known is null without a label, 1 or 0 for its quality; good are those of quality 1 and not toxic."""
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    rows = docs.select(F.col(key).alias("label_key"), F.col(text).alias("text")).join(F.broadcast(some_labels(labels, most)), "label_key", "left")
    return rows.select("text", "known", held.alias("held"), F.coalesce((F.col("known") == 1) & (F.col("harm") == 0), F.lit(False)).alias("good"))


class Model:
    """ratio: log p_target - log p_raw by place. share: of the labelled rows that are fitted on, the part that is good. usable: there are labelled texts of both kinds."""

    def __init__(self, docs: DataFrame, labels: DataFrame, key: str, text: str, max_labels: int):
        rows = labelled(docs, labels, key, text, max_labels)
        known = rows.filter("known IS NOT NULL AND NOT held").agg(F.count("*"), F.count_if("good")).first()
        self.share = known[1] / known[0] if known[0] else 1.0
        self.usable = 0 < self.share < 1
        self.ratio = np.zeros(BUCKETS)
        if not self.usable:
            return
        tables = rows.select("text", (F.col("good") & ~F.col("held")).alias("target")).mapInPandas(tally, "lane int, piece int, width int, counts binary")
        for keys in (["lane", "piece"], ["piece"]):
            tables = tables.groupBy(*keys).applyInPandas(add_tables, "lane int, piece int, width int, counts binary")
        counts = {r.piece: np.frombuffer(r.counts, np.int64).reshape(2, -1) for r in tables.collect()}  # PIECES rows
        raw, target = np.concatenate([counts[i] for i in range(PIECES)], axis=1).astype(float)
        for part in (slice(0, WORDS), slice(WORDS, None)):
            raw[part] *= target[part].sum() / max(raw[part].sum(), 1.0)  # as if as many n-grams had been drawn from raw text
        ratio = np.log((target + PRIOR) / (raw + PRIOR))
        self.ratio = np.where(np.abs(ratio) >= np.log(FACTOR), ratio, 0.0)


def weigh(ratio: np.ndarray):
    """The log weight of each text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([float(ratio[grams(t)].sum()) for t in texts], dtype=float)

    return run


def top_k(scored: DataFrame, k: int, bins: int = 4096, few: int = 10_000, *, draws: DataFrame | None = None) -> DataFrame:
    """Adds selected: among the k rows of greatest `draw` (ties by row_id). The k-th is found by counts of ever finer bins; only its bin is ranked.

    draws: row_id and draw of the same rows, if these are at hand in a smaller table.
    """
    draws = scored if draws is None else draws
    lo, hi = draws.agg(F.min("draw"), F.max("draw")).first()
    above = 0
    if lo is None or k <= 0:
        return scored.withColumn("selected", F.lit(False))
    while True:
        inside = draws.filter((F.col("draw") >= lo) & (F.col("draw") <= hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width <= lo:
            break
        at = F.least(F.floor((F.col("draw") - lo) / width), F.lit(bins - 1))
        counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("draw").alias("lo"), F.max("draw").alias("hi")).orderBy(F.desc("bin")).collect()  # at most `bins` rows
        for row in counts:
            if above + row.n >= k:
                break
            above += row.n
        if row.n <= few or (row.lo, row.hi) == (lo, hi):
            lo, hi = row.lo, row.hi
            break
        lo, hi = row.lo, row.hi
    edge = draws.filter((F.col("draw") >= lo) & (F.col("draw") <= hi)).select("row_id", "draw").orderBy(F.desc("draw"), "row_id").limit(max(0, k - above))
    edge = edge.select("row_id", F.lit(True).alias("edge"))
    return scored.join(edge, "row_id", "left").withColumn("selected", (F.col("draw") > hi) | F.coalesce("edge", F.lit(False))).drop("edge")


def select_quality(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", share=None, seed=7, max_labels=MAX_LABELS, keep_row=False) -> DataFrame:
    """Per row of docs: key, log_weight, draw (log_weight and Gumbel noise), selected: whether it is among the k rows of greatest draw.

    k is `share` of the rows, rounded; without `share`, the number of rows whose log_weight is no less than that of all but SPARED
    of the held-out good documents (the part of good ones among the labelled, where none is held out). labels (doc_id, quality, toxic):
    good is quality 1 and toxic 0 (null toxic: 0); null quality or id is no label, of several labels for an id the worst counts.
    Null and empty texts weigh 0 and are drawn like others. The noise depends on key and text, so equal rows draw alike and
    ties go by place. Without labelled texts both good and not all weigh 0, and all are selected unless `share` is given. A long
    text weighs as all its n-grams. An empty table gives an empty result. Other columns of docs, whatever their names, are
    ignored, or come along in the struct `row` with keep_row.
    """
    model = Model(docs, labels, key, text, max_labels)
    row = F.struct("*") if keep_row else F.struct(F.col(key))
    unit = (F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.pandas_udf(weigh(model.ratio), "double")(F.col(text)) if model.usable else F.lit(0.0)
    scored = docs.select(F.monotonically_increasing_id().alias("row_id"), row.alias("row"), F.col(key).alias("key"), (F.pmod(F.xxhash64(F.col(text)), F.lit(HELD_OUT)) == 0).alias("held"), weight.alias("log_weight"), (-F.log(-F.log(unit))).alias("noise"))
    good = F.broadcast(some_labels(labels, max_labels).filter("known = 1 AND harm = 0").select("label_key"))
    scored = scored.join(good, F.col("key") == F.col("label_key"), "left")
    check = F.col("held") & F.col("label_key").isNotNull()
    scored = store(scored.select("row_id", "row", "key", "log_weight", (F.col("log_weight") + F.col("noise")).alias("draw"), F.coalesce(check, F.lit(False)).alias("check")), "quality-draws")
    if share is not None or not model.usable:
        k = round((1.0 if share is None else share) * scored.count())
    else:
        least = scored.filter("check").agg(F.percentile("log_weight", F.lit(SPARED))).first()[0]
        k = round(model.share * scored.count()) if least is None else scored.filter(F.col("log_weight") >= least).count()
    return top_k(scored, k, draws=scored.select("row_id", "draw")).select(F.col("key").alias(key), "log_weight", "draw", "selected", *(["row"] if keep_row else []))

"""Language-model scoring by Katz backoff over n-grams of any order up to MOST_ORDER.

P_m(w | context) is the Good-Turing discounted share of the counts after the context where the n-gram was seen, and
alpha(context) * P_{m-1}(w | shorter context) where it was not; alpha is what the discounts free, over what P_{m-1} leaves
for the words not seen after the context, so that each distribution sums to 1. P_1 gives one class of all unseen words
what the discounts of the single words free. Each token is scored by that recursion, from order 1 up.

Chunks. Texts are cut into chunks of about `chunk_tokens` tokens and kept as numbers: a chunk's sorted distinct word hashes,
and every token's place among them. A chunk asks for each distinct word, and for each distinct n-gram, once. With a
word's count it is told the word's number, which is shorter than the hash once sorted ones are written as steps.

Tables. The n-grams that chunks hold are dealt by the word before the last, v, so that all n-grams of all orders that
end in (v, w), and all contexts that end in v, lie in one row of the stored table, which holds some `bucket_tokens` of
them. Words v too frequent for that (more than HOT * bucket_tokens, or than 1 / BALANCE of all tokens) are dealt by the whole
n-gram instead, and the counts and sums of their shorter n-grams and contexts are added up over rows, an entry a
row and key. Nothing is broadcast; what goes to the driver is
a few numbers an order.
"""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import HASHES, remove, store, words_of

ORDER, MOST_ORDER, GOOD = 3, 7, 5
CHUNK_TOKENS, BUCKET_TOKENS = 1_000_000, 300_000
#: Texts that a worker is handed at once: Arrow's buffers for larger batches stay with the executor to its end.
TEXTS = 500
#: Rows of the table whose n-grams are shuffled together: larger groups repeat fewer word numbers.
GROUP = 6
#: A word that comes more than HOT * bucket_tokens times is spread over rows.
HOT = 3
#: A word with a greater share than 1 / BALANCE is spread, so that no task has much more to do than others.
BALANCE = 150
#: Frequent words that a partition of the words reports to size the spread part of the table.
REPORTED = 64
#: Hashes that stand for the place before a text, the least one, whose number is 0, and for its end.
BEGIN, END = np.uint64(0), np.uint64(2**64 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
CONTEXT_TAG, TAGS = 8, 16
CHUNK = "chunk long, n long, n_words long, keys array<string>, held binary, words binary, counts binary, ids binary, lens binary"
BLOCK = "bucket long, chunk long, words binary, totals binary, cols array<binary>, counts binary"
TABLE = "bucket long, words binary, totals binary, cols array<binary>, counts binary, chunks array<long>, places array<binary>, seen array<double>, hot boolean, keys binary, vals binary, n_keys long"


@functools.cache
def libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps its own ways
        return None


def give_back() -> None:
    """Returns freed memory to the system, which the C library else keeps for a worker that may do something small next."""
    if libc() is not None:
        libc().malloc_trim(0)


def packed(a: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as narrow as they fit, compressed by planes of bytes, after a letter that names their type. rising: their steps instead."""
    a = np.asarray(a)
    if rising and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    narrow = a.astype(np.min_scalar_type(a.max()) if a.dtype.kind == "u" and len(a) else np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
    planes = narrow.view(np.uint8).reshape(len(narrow), narrow.itemsize).T
    return narrow.dtype.char.encode() + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(b: bytes, rising: bool = False, kind=np.int64) -> np.ndarray:
    narrow = np.dtype(b[:1].decode())
    planes = np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(narrow.itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(narrow).reshape(-1).astype(kind)
    return np.cumsum(a, dtype=kind) if rising else a


def hashes(b: bytes) -> np.ndarray:
    """Sorted hashes or numbers that packed(..., rising=True) wrote."""
    return unpacked(b, True, np.uint64)


def packed_floats(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a, np.float64).tobytes(), 1)


def floats(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), np.float64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def ranges(buckets: int) -> np.ndarray:
    """The first hash of every bucket but the first."""
    return np.array([-(-b * 2**64 // buckets) for b in range(1, buckets)], np.uint64)


def ranked(cols: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers below `size`: the place of one row of each kind, in order of columns, and the kind of every row."""
    key, room = cols[0].astype(np.int64), size
    for col in cols[1:]:
        if room * size >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            room = len(key) + 1
        key, room = key * size + col, room * size
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, inverse.astype(np.int32)


def chunks(chunk_tokens: int):
    """Of (key, held_out, text), the chunks of one task."""

    def flush(name, keys, held, rows):
        lens = np.array([len(r) for r in rows])
        words, ids = np.unique(np.concatenate(rows), return_inverse=True)
        held = np.array(held)
        counts = np.bincount(ids[np.repeat(~held, lens)], minlength=len(words))
        # The place before a text counts as a word that comes once a text.
        return pd.DataFrame({
            "chunk": [name], "n": [len(ids)], "n_words": [len(words) + 1], "keys": [keys], "held": [held.tobytes()], "words": [packed(np.concatenate([[BEGIN], words]), True)],
            "counts": [packed(np.concatenate([[np.count_nonzero(~held)], counts]))], "ids": [packed(ids + 1)], "lens": [packed(lens)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = TaskContext.get().partitionId() << 32
        keys, held, rows, n = [], [], [], 0
        for batch in batches:
            for k, h, t in zip(batch["key"], batch["held_out"], batch["text"]):
                words = words_of(t)
                one = np.empty(len(words) + 1, np.uint64)
                one[:-1] = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
                one[-1] = END
                keys.append(k)
                held.append(bool(h))
                rows.append(one)
                n += len(one)
                if n >= chunk_tokens:
                    yield flush(name, keys, held, rows)
                    name, keys, held, rows, n = name + 1, [], [], [], 0
                    give_back()
        if rows:
            yield flush(name, keys, held, rows)

    return run


def count_of_counts(c: np.ndarray) -> np.ndarray:
    """How many are 1, 2, ... GOOD + 1."""
    return np.bincount(c[(c >= 1) & (c <= GOOD + 1)].astype(np.int64), minlength=GOOD + 2)[1:].astype(float)


def added_up(requests: DataFrame, entries: int, width: int) -> DataFrame:
    """(src, parts, numbers): for each src the sums over all of them of the values of its keys, in order of keys, and the keys' numbers.

    requests: (src, keys, vals), sorted distinct hashes and `width` rows of numbers. A key meets in a task one entry from
    each src. Numbers rise with the keys: the partition and the place in it. The stored table, `answered`, also has seen:
    the number and sum of the first totals and their counts of counts, by tag (the low bits of a key).
    """
    buckets = max(1, -(-entries // BUCKET_TOKENS))
    bounds = ranges(buckets)

    def deal(batches):
        for batch in batches:
            for src, keys, vals in zip(batch["src"], batch["keys"], batch["vals"]):
                keys, vals = hashes(keys), floats(vals).reshape(width, -1)
                cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                own = [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
                if not own:
                    continue
                yield pd.DataFrame({"bucket": [b for b, _, _ in own], "src": src, "keys": [packed(keys[x:y], True) for _, x, y in own], "vals": [packed_floats(vals[:, x:y]) for _, x, y in own]})

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys = [hashes(k) for k in group["keys"]]
        vals = np.concatenate([floats(v).reshape(width, -1) for v in group["vals"]], axis=1)
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.stack([np.bincount(inverse, weights=v, minlength=len(every)) for v in vals])
        tags = (every & np.uint64(TAGS - 1)).astype(int)
        real = (every != BEGIN) & (totals[0] > 0)
        seen = np.concatenate([[np.count_nonzero(real & (tags == t)), totals[0][real & (tags == t)].sum(), *count_of_counts(totals[0][real & (tags == t)])] for t in range(TAGS)])
        ends = np.cumsum([len(k) for k in keys])
        parts = [packed_floats(totals[:, inverse[e - len(k) : e]]) for k, e in zip(keys, ends)]
        base = np.uint64(int(group["bucket"].iloc[0]) << 32)
        numbers = [packed(base + inverse[e - len(k) : e].astype(np.uint64), True) for k, e in zip(keys, ends)]
        none = [None] * (len(keys) - 1)
        return pd.DataFrame({"src": group["src"], "bucket": group["bucket"], "part": parts, "number": numbers, "seen": [seen, *none], "most": [np.sort(totals[0])[-REPORTED:], *none]})

    answered = store(requests.mapInPandas(deal, "bucket long, src long, keys binary, vals binary").groupBy("bucket").applyInPandas(answer, "src long, bucket long, part binary, number binary, seen array<double>, most array<double>"), "lm-sums", 16)
    parts = F.sort_array(F.collect_list(F.struct("bucket", "part", "number")))
    out = answered.groupBy("src").agg(parts.alias("all")).select("src", F.transform("all", lambda x: x["part"]).alias("parts"), F.transform("all", lambda x: x["number"]).alias("numbers"))
    out.answered = answered
    return out


def stats(table: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays `seen`, on the driver: `size` numbers."""
    out = np.zeros(size)
    for row in table.filter("seen IS NOT NULL").select(F.posexplode("seen")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[row.pos] = row.n
    return out


def discounts(seen: np.ndarray) -> np.ndarray:
    """Good-Turing's factor for counts 0 (none), 1 to GOOD and above (1), from counts of counts; where these give none below 1, half a count is taken off."""
    over = (GOOD + 1) * seen[GOOD] / seen[0] if seen[0] else 1.0
    out = [0.0]
    for r in range(1, GOOD + 1):
        d = ((r + 1) * seen[r] / (r * seen[r - 1]) - over) / (1 - over) if seen[r - 1] and over < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array([*out, 1.0])


def discounted(c: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return c * factors[np.minimum(c, GOOD + 1).astype(np.int64)]


class Deal:
    """Where n-grams go: to one of `groups` by the word before the last, those after hot words to one of `hot_groups` more."""

    def __init__(self, groups: int, hot_groups: int, hot_tokens: float):
        self.bounds, self.hot_bounds, self.hot_tokens, self.groups = ranges(groups), ranges(hot_groups), hot_tokens, groups


class Typed:
    """The distinct n-grams of a chunk by bucket: columns are the words before the last, the nearest first, and the last."""

    def __init__(self, row, order: int, deal: Deal):
        self.words = np.concatenate([hashes(n) for n in row.numbers])
        self.totals = np.concatenate([floats(p) for p in row.parts])
        self.lens, self.ids = unpacked(row.lens), unpacked(row.ids, kind=np.int32)
        self.held = np.frombuffer(row.held, bool)
        self.starts = np.cumsum(self.lens) - self.lens
        within = np.arange(len(self.ids)) - np.repeat(self.starts, self.lens)
        before = []
        for k in range(1, order):
            shifted = np.zeros_like(self.ids)
            shifted[k:] = self.ids[:-k]
            before.append(np.where(within >= k, shifted, np.int32(0)))
        cols = [*before, self.ids]
        first, self.kind = ranked(cols, len(self.words))
        self.cols = [c[first] for c in cols]
        self.counts = np.bincount(self.kind, weights=np.repeat(~self.held, self.lens), minlength=len(first))
        v = self.cols[0]
        at = mixed(self.words * MIX)[v]
        hot = self.totals[v] > deal.hot_tokens
        whole = np.zeros(np.count_nonzero(hot), np.uint64)
        for c in self.cols:
            whole = mixed(whole * MIX + self.words[c[hot]])
        bucket = np.searchsorted(deal.bounds, at, side="right")
        bucket[hot] = len(deal.bounds) + 1 + np.searchsorted(deal.hot_bounds, whole, side="right")
        self.order = np.argsort(bucket, kind="stable")
        self.buckets, self.begins = np.unique(bucket[self.order], return_index=True)


def packed_columns(cols) -> list[bytes]:
    """The first of the sorted columns rises."""
    return [packed(c, i == 0) for i, c in enumerate(cols)]


def blocks(order: int, deal: Deal):
    """A chunk's n-grams, a row for each bucket, with the words that they hold and these words' counts in all chunks."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                t = Typed(row, order, deal)
                rows = []
                for b, x, y in zip(t.buckets, t.begins, [*t.begins[1:], len(t.order)]):
                    some = t.order[x:y]
                    own, inside = np.unique(np.concatenate([c[some] for c in t.cols]), return_inverse=True)
                    rows.append((int(b), row.chunk, packed(t.words[own], True), packed(t.totals[own]), packed_columns(inside.reshape(order, -1)), packed(t.counts[some])))
                del t
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "words", "totals", "cols", "counts"])
                give_back()

    return run


class Bucket:
    """The distinct n-grams of a bucket in order of columns, and for each order m their m-gram and its context, numbered."""

    def __init__(self, words: np.ndarray, totals: np.ndarray, cols: list[np.ndarray], counts: np.ndarray, hot_tokens: int):
        self.words, self.totals, self.cols, self.counts, self.n = words, totals, cols, counts, len(cols)
        self.hot = totals[cols[0]] > hot_tokens
        self.context, self.gram, new = {}, {}, np.zeros(len(counts), bool)
        new[:1] = True
        for m in range(2, self.n + 1):
            col = cols[m - 2]
            new[1:] |= col[1:] != col[:-1]
            self.context[m] = np.cumsum(new, dtype=np.int32) - 1
            self.gram[m] = np.arange(len(counts), dtype=np.int32) if m == self.n else ranked([self.context[m], cols[-1]], max(len(words), len(counts)))[1]
        self.c = {m: np.bincount(g, weights=counts)[g] for m, g in self.gram.items()}
        self.after = {m: np.bincount(x, weights=counts)[x] for m, x in self.context.items()}
        self.after[2] = np.where(self.hot, totals[cols[0]], self.after[2])

    def keys(self, m: int, context: bool) -> np.ndarray:
        h = np.zeros(np.count_nonzero(self.hot), np.uint64)
        for col in self.cols[: m - 1] + ([] if context else self.cols[-1:]):
            h = mixed(h * MIX + self.words[col[self.hot]])
        return h & ~np.uint64(TAGS - 1) | np.uint64(m + CONTEXT_TAG * context)

    def partial(self) -> tuple[np.ndarray, np.ndarray]:
        """What other buckets must add to: the counts of shorter n-grams and of contexts after hot words."""
        keys = np.concatenate([np.zeros(0, np.uint64), *[self.keys(m, False) for m in range(2, self.n)], *[self.keys(m, True) for m in range(3, self.n + 1)]])
        every, first = np.unique(keys, return_index=True)
        own = np.concatenate([np.zeros(0), *[self.c[m][self.hot] for m in range(2, self.n)], *[self.after[m][self.hot] for m in range(3, self.n + 1)]])
        return every, own[first]

    def complete(self, keys: np.ndarray, totals: np.ndarray) -> None:
        self.part = {m: c.copy() for m, c in self.c.items()}
        for context, table in ((False, self.c), (True, self.after)):
            for m in range(2 + context, self.n + context):
                table[m][self.hot] = totals[np.searchsorted(keys, self.keys(m, context))]

    def whole_counts(self) -> list[np.ndarray]:
        """Counts of counts of each order from 2, of what lies in this bucket alone."""
        out = []
        for m in range(2, self.n + 1):
            first = first_places(self.gram[m])
            own = first if m == self.n else first[~self.hot[first]]
            out.append(count_of_counts(self.c[m][own]))
        return out


def merge(order: int, deal: Deal, bucket_tokens: int):
    """Rows of the table from a group's blocks, each of some bucket_tokens n-grams: cut between words v, but not where hot ones are dealt."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        name, chunks = int(group["bucket"].iloc[0]), group["chunk"].to_numpy()
        words = [hashes(w) for w in group["words"]]
        every, first = np.unique(np.concatenate(words), return_index=True)
        totals = np.concatenate([unpacked(t) for t in group["totals"]])[first]
        cols = [[] for _ in range(order)]
        for own, some in zip(words, group["cols"]):
            place = np.searchsorted(every, own).astype(np.int32)
            for i, c in enumerate(some):
                cols[i].append(place[unpacked(c, i == 0)])
        del words
        counts = [unpacked(c, kind=np.int32) for c in group["counts"]]
        of_v = sum(np.bincount(c, minlength=len(every)) for c in cols[0])
        edges = slices(of_v, bucket_tokens) if name < deal.groups else np.zeros(1, np.int64)
        cuts = [np.searchsorted(c, edges).tolist() + [len(c)] for c in cols[0]]  # v rises in a block
        rows = []
        for k in range(len(edges)):
            held = [(i, x[k], x[k + 1]) for i, x in enumerate(cuts) if x[k] < x[k + 1]]
            if held:
                part = [np.concatenate([c[i][x:y] for i, x, y in held]) for c in cols]
                rows.append(table_row(name << 20 | k, every, totals, part, [counts[i][x:y] for i, x, y in held], chunks[[i for i, _, _ in held]], deal.hot_tokens))
        del cols, counts, every, totals
        give_back()
        return pd.DataFrame(rows)

    return run


def slices(tokens: np.ndarray, most: int) -> np.ndarray:
    """Where to cut words so that a slice has some `most` tokens; a word with more than half as many is a slice of its own."""
    heavy = tokens > most / 2
    light = np.where(heavy, 0, tokens)
    piece = np.cumsum(light) // most
    new = np.diff(piece, prepend=-1) > 0
    new |= heavy
    new[1:] |= heavy[:-1]
    return np.flatnonzero(new)


def count_stats(cols: list[np.ndarray], counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Counts of counts of each order from 2, of n-grams that lie in one row of the table whole, an order at a time."""
    out = []
    for m in range(2, len(cols)):
        kind = ranked([*cols[: m - 1], cols[-1]], size)[1]
        out.append(count_of_counts(np.bincount(kind, weights=counts)))
    return [*out, count_of_counts(counts)]


def table_row(name: int, every: np.ndarray, totals: np.ndarray, cols: list[np.ndarray], counts: list[np.ndarray], chunks: np.ndarray, hot_tokens: float) -> dict:
    used = np.unique(np.concatenate([np.unique(c) for c in cols]))
    place = np.zeros(len(every), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    cols = [place[c] for c in cols]
    every, totals = every[used], totals[used]
    first, kind = ranked(cols, len(every))
    cols = [c[first] for c in cols]
    ends = np.cumsum([len(c) for c in counts])
    places = [packed(kind[e - len(c) : e], True) for c, e in zip(counts, ends)]
    counts = np.bincount(kind, weights=np.concatenate(counts), minlength=len(first))
    del first, kind
    hot, keys, vals = bool((totals[cols[0]] > hot_tokens).any()), np.zeros(0, np.uint64), np.zeros(0)
    if hot:
        bucket = Bucket(every, totals.astype(float), cols, counts, hot_tokens)
        (keys, vals), seen = bucket.partial(), bucket.whole_counts()
    else:
        seen = count_stats(cols, counts, len(every))
    return {
        "bucket": name, "words": packed(every, True), "totals": packed(totals), "cols": packed_columns(cols), "counts": packed(counts), "chunks": chunks.tolist(), "places": places,
        "seen": np.concatenate(seen), "hot": hot, "keys": packed(keys, True), "vals": packed_floats(vals), "n_keys": len(keys),
    }


class Model:
    """The numbers that all tasks need: the discount factors of each order, and what single words have."""

    def __init__(self, n: float, distinct: float, factors: list[np.ndarray], seen: np.ndarray):
        self.n, self.distinct, self.factors = n, distinct, factors
        counts = np.arange(1, GOOD + 1)
        free = float((seen[:GOOD] * (counts - discounted(counts, factors[0]))).sum())  # one count if nothing was discounted
        self.whole, self.unseen = (n, free / n) if free > 0 else (n + 1, 1 / (n + 1))

    def single(self, totals: np.ndarray) -> np.ndarray:
        return np.where(totals > 0, discounted(totals, self.factors[0]) / self.whole, self.unseen)


def first_places(kinds: np.ndarray) -> np.ndarray:
    """The first place of each kind, kinds being numbered from 0 without gaps."""
    first = np.empty(int(kinds.max()) + 1 if len(kinds) else 0, np.int64)
    first[kinds[::-1]] = np.arange(len(kinds) - 1, -1, -1)
    return first


def probabilities(b: Bucket, model: Model, sums: dict[int, tuple[np.ndarray, np.ndarray]]):
    """log10 P of each n-gram by the recursion, or, at the first order m whose contexts after hot words lack their sums, (keys, vals) to add up. sums: per order (keys, [kept, below])."""
    p = model.single(b.totals)[b.cols[-1]]
    floor = np.full(len(p), model.unseen)  # the probability of the unseen class: no more can be missing below it
    for m in range(2, b.n + 1):
        x, g, c, after = b.context[m], b.gram[m], b.c[m], b.after[m]
        given = discounted(c, model.factors[m - 1])
        one = np.zeros(len(p), np.float32)
        one[first_places(g)] = 1  # each m-gram once
        if b.hot.any():
            one = one.astype(float)
            one[b.hot] = b.counts[b.hot] / np.maximum(c[b.hot], 1)  # over all buckets, the shares of one m-gram add up to 1
        one[c == 0] = 0
        kept, below = (np.bincount(x, weights=one * y)[x] for y in (given, p))
        if b.hot.any():
            keys = b.keys(m, True)
            if m not in sums:
                every, first = np.unique(keys, return_index=True)
                return every, np.stack([kept[b.hot][first], below[b.hot][first]])
            at = np.searchsorted(sums[m][0], keys)
            kept[b.hot], below[b.hot] = sums[m][1][0][at], sums[m][1][1][at]
        scale = np.where(kept < after * (1 - 1e-12), after, after + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(after > 0, np.maximum(1 - kept / scale, 0) / np.maximum(1 - below, floor), 1.0)
        p = np.where(c > 0, given / scale, alpha * p)
        floor = alpha * floor
    return np.log10(p)


def read_bucket(row, hot_tokens: int) -> Bucket:
    b = Bucket(hashes(row.words), unpacked(row.totals).astype(float), [unpacked(c, i == 0, np.int32) for i, c in enumerate(row.cols)], unpacked(row.counts).astype(float), hot_tokens)
    if row.n_keys:
        b.complete(hashes(row.keys), np.concatenate([floats(p) for p in row.parts]))
    return b


def asked(model: Model, order: int, hot_tokens: int):
    """What buckets ask at an order: the sums of contexts after hot words."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                b = read_bucket(row, hot_tokens)
                keys, vals = probabilities(b, model, sums_of(row, order))
                yield pd.DataFrame({"bucket": [row.bucket], "keys": [packed(keys, True)], "vals": [packed_floats(vals)]})

    return run


def sums_of(row, upto: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for m in range(2, upto):
        keys = getattr(row, f"keys_{m}", None)
        if keys is not None:
            out[m] = (hashes(keys), np.concatenate([floats(p).reshape(2, -1) for p in getattr(row, f"parts_{m}")], axis=1))
    return out


def answers(model: Model, order: int, hot_tokens: int):
    """(chunk, bucket, part): log10 P of the n-grams that a chunk has in a bucket, in its order."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                logs = probabilities(read_bucket(row, hot_tokens), model, sums_of(row, order + 1))
                yield pd.DataFrame({"chunk": row.chunks, "bucket": row.bucket, "part": [packed_floats(logs[unpacked(p, True)]) for p in row.places]})
                del logs
                give_back()

    return run


def scored(model: Model, order: int, deal: Deal):
    """The rows of a chunk with the sums of their tokens."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                t = Typed(row, order, deal)
                logs = np.empty(len(t.order))
                logs[t.order] = np.concatenate([floats(p) for p in row.logs])
                c = t.totals[t.ids]
                sums = [np.add.reduceat(x, t.starts) for x in (c > 0, np.log10((c + 1) / (model.n + model.distinct + 1)), logs[t.kind])]
                yield pd.DataFrame({"key": row.keys, "held_out": t.held, "n_tokens": t.lens, "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2]})
                del t, logs, c, sums
                give_back()

    return run


def score_texts(docs: DataFrame, *, key="doc_id", text="text", held_out=(7, 2), order=ORDER, chunk_tokens=CHUNK_TOKENS, bucket_tokens=BUCKET_TOKENS) -> DataFrame:
    """Per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(key as text) modulo held_out[0] is held_out[1] are not learned from. A null or empty text has one
    token, its end. A null key counts as an empty key text. Repeated rows each count and each give their row; there are no
    ties to break. A long text is one chunk, of its own length. If there is nothing to learn from, every token has the
    probability of the unseen class, 1; an empty table gives an empty result. Other columns are ignored, whatever
    their names. key: of a type that can be read back from its text. order: 2 to MOST_ORDER.
    """
    if not 2 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 2 to {MOST_ORDER}")
    spark = docs.sparkSession
    mod, out = held_out
    name = F.col(key).cast("string")
    held = F.pmod(F.crc32(F.coalesce(name, F.lit("")).cast("binary")), F.lit(mod)) == out
    rows = docs.select(name.alias("key"), held.alias("held_out"), F.col(text).alias("text"))
    texts = store(rows.mapInPandas(chunks(chunk_tokens), CHUNK), "lm-chunks", TEXTS)

    def as_request(batches):
        for batch in batches:
            yield pd.DataFrame({"src": batch["chunk"], "keys": batch["words"], "vals": [packed_floats(unpacked(c)) for c in batch["counts"]]})

    entries, n_all = texts.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    totals = added_up(texts.select("chunk", "words", "counts").mapInPandas(as_request, "src long, keys binary, vals binary"), entries, 1)
    seen = stats(totals.answered, TAGS * (GOOD + 3)).reshape(TAGS, -1).sum(0)
    distinct, n, first_order = seen[0], seen[1], seen[2:]
    sized = store(texts.drop("words", "counts", "n", "n_words").join(totals.withColumnRenamed("src", "chunk"), "chunk"), "lm-sized")

    hot_tokens = min(HOT * bucket_tokens, n_all / BALANCE)
    hot_sum = totals.answered.select(F.explode("most").alias("t")).filter(F.col("t") > hot_tokens).agg(F.coalesce(F.sum("t"), F.lit(0.0))).first()[0]
    remove(spark, texts, totals.answered)
    deal = Deal(max(1, -(-n_all // (GROUP * bucket_tokens))), max(1, math.ceil(hot_sum / bucket_tokens)), hot_tokens)
    dealt = sized.select("chunk", "held", "ids", "lens", "parts", "numbers").mapInPandas(blocks(order, deal), BLOCK)
    table = store(dealt.groupBy("bucket").applyInPandas(merge(order, deal, bucket_tokens), TABLE), "lm-table", 1)
    by_order = stats(table, (order - 1) * (GOOD + 1)).reshape(order - 1, -1)

    # Counts and sums of what hot words spread over rows; the other rows need no more than their own.
    hot = table.filter("hot")
    n_hot, hot_entries = hot.agg(F.count("*"), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
    temporary, logs = [], []
    if n_hot:
        whole = added_up(hot.select(F.col("bucket").alias("src"), "keys", "vals"), hot_entries, 1)
        temporary.append(whole.answered)
        by_order[:-1] += stats(whole.answered, TAGS * (GOOD + 3)).reshape(TAGS, -1)[2:order, 2:]
    model = Model(n, distinct, [discounts(first_order), *map(discounts, by_order)], first_order)
    part = "chunk long, bucket long, part binary"
    if n_hot:
        hot = store(hot.join(whole.select(F.col("src").alias("bucket"), "parts"), "bucket", "left"), "lm-hot")
        temporary.append(hot)
        for m in range(2, order + 1):
            asks = store(hot.mapInPandas(asked(model, m, hot_tokens), "bucket long, keys binary, vals binary"), "lm-asked", 1)
            sums = added_up(asks.select(F.col("bucket").alias("src"), "keys", "vals"), hot_entries, 2)
            temporary += [asks, sums.answered]
            sums = sums.select(F.col("src").alias("bucket"), F.col("parts").alias(f"parts_{m}")).join(asks.select("bucket", F.col("keys").alias(f"keys_{m}")), "bucket")
            hot = hot.join(sums, "bucket", "left")
        logs.append(store(hot.mapInPandas(answers(model, order, hot_tokens), part), "lm-hot-logs", 1))
        remove(spark, *temporary)
    logs.append(store(table.filter("NOT hot").mapInPandas(answers(model, order, hot_tokens), part), "lm-logs", 1))
    remove(spark, table)

    gathered = functools.reduce(DataFrame.unionByName, logs).groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "part"))), lambda x: x["part"]).alias("logs"))
    result = sized.join(gathered, "chunk").mapInPandas(scored(model, order, deal), "key string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    result = store(result, "lm-scores", 1)
    remove(spark, sized, *logs)
    kind = docs.schema[key].dataType
    return result.select(F.col("key").cast(kind).alias(key), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")

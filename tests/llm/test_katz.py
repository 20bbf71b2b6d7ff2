"""Katz backoff against a brute-force recursion, with words spread over buckets and without."""

import functools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import katz
from marlstone.llm.katz import GOOD, count_of_counts, discounts, score_texts


class Brute:
    def __init__(self, texts, order):
        self.order, self.train = order, [t.split() + ["</s>"] for k, t in texts if zlib.crc32(str("" if k is None else k).encode()) % 7 != 2]
        self.counts = {m: Counter() for m in range(1, order + 1)}
        for t in self.train:
            x = ["<s>"] * (order - 1) + t
            for i in range(order - 1, len(x)):
                for m in self.counts:
                    self.counts[m][tuple(x[i - m + 1 : i + 1])] += 1
        self.factors = {m: discounts(count_of_counts(np.array(list(c.values())))) for m, c in self.counts.items()}
        self.n = sum(self.counts[1].values())
        free = self.n - sum(self.cut(c, 1) for c in self.counts[1].values())
        self.whole, self.free = (self.n, free) if free > 1e-12 else (self.n + 1, 1)
        self.after = {m: {} for m in range(2, order + 1)}
        for m, found in self.after.items():
            for g, c in self.counts[m].items():
                found.setdefault(g[:-1], {})[g[-1]] = c
        self.p = functools.cache(self._p)

    def cut(self, c, m):
        return c * self.factors[m][min(c, GOOD + 1)]

    def _p(self, g):
        m = len(g)
        if m == 1:
            return (self.cut(self.counts[1][g], 1) if g in self.counts[1] else self.free) / self.whole
        seen = self.after[m].get(g[:-1])
        if not seen:
            return self.p(g[1:])
        total, kept = sum(seen.values()), sum(self.cut(c, m) for c in seen.values())
        scale = total if kept < total * (1 - 1e-12) else total + 1
        if g[-1] in seen:
            return self.cut(seen[g[-1]], m) / scale
        return (1 - kept / scale) / (1 - sum(self.p((*g[1:-1], w)) for w in seen)) * self.p(g[1:])

    def score(self, text):
        x = ["<s>"] * (self.order - 1) + text.split() + ["</s>"]
        return sum(math.log10(self.p(tuple(x[j - self.order + 1 : j + 1]))) for j in range(self.order - 1, len(x)))


def texts():
    r = random.Random(3)
    word = lambda: r.choice("abcdefghij") if r.random() < 0.8 else r.choice(["k", "l", "mm", f"zz{r.randint(0, 30)}"])
    return [(i, " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(80)]


@pytest.mark.parametrize(("order", "chunk", "bucket"), [(2, 100, 60), (3, 10**6, 10**6), (3, 100, 60), (4, 100, 200)])
def test_scores_equal_the_recursion(spark, order, chunk, bucket):
    rows = texts()
    brute = Brute(rows, order)
    uni = brute.counts[1]
    for m, found in brute.after.items():
        for context in list(found)[:40]:
            assert math.isclose(sum(brute.p((*context, w)) for w in [*(w for (w,) in uni), "<unseen>"]), 1, abs_tol=1e-9), m
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = score_texts(docs, order=order, chunk_tokens=chunk, bucket_tokens=bucket).collect()
    assert len(got) == len(rows)
    for row in got:
        t = [(w,) for w in [*dict(rows)[row.doc_id].split(), "</s>"]]
        assert math.isclose(row.score, brute.score(dict(rows)[row.doc_id]), abs_tol=1e-6)
        assert math.isclose(row.base_score, sum(math.log10((uni[w] + 1) / (brute.n + len(uni) + 1)) for w in t), abs_tol=1e-6)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(t), sum(w in uni for w in t), brute.n)


def test_odd_rows(spark):
    long = "w x " * 30000
    rows = [(1, "a b a", "n"), (1, "a b a", "n"), (None, "a b", None), (2, None, "n"), (3, "", "n"), (4, long, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    brute = Brute([(k, t or "") for k, t, _ in rows], 3)
    got = score_texts(docs, chunk_tokens=100, bucket_tokens=50).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got) == sorted((k is None, k, len((t or "").split()) + 1) for k, t, _ in rows)
    for r in got:
        assert math.isclose(r.score, brute.score(next(t for k, t, _ in rows if k == r.doc_id) or ""), rel_tol=1e-9)
    assert score_texts(docs.limit(0)).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in score_texts(only_held).collect()} == {(0, 0, 0.0, 0.0)}


def test_texts_are_handed_over_in_small_batches(spark, monkeypatch):
    """A batch of 10,000 whole texts stays in the executor's Arrow buffers; a row of the table has no more n-grams than half a group of before."""
    taken, write = {}, katz.store
    monkeypatch.setattr(katz, "store", lambda df, label, rows=None: (taken.setdefault(label, rows), write(df, label, rows))[1])
    docs = spark.createDataFrame([(i, f"a b {i % 7}") for i in range(40)], "doc_id long, text string")
    assert katz.score_texts(docs).count() == 40
    assert taken["lm-chunks"] is not None and taken["lm-chunks"] <= 1000
    tokens = np.full(5000, 1000)
    assert max(np.add.reduceat(tokens, katz.slices(tokens, katz.BUCKET_TOKENS))) <= 301_000

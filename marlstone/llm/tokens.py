"""Token counts that follow edits, from segment trees of pre-tokens.

A text is cut into leaves of whole pre-tokens, at places where every pre-token ends whatever stands further away. A tree
over the leaves holds the sums of characters and tokens. An edit re-encodes the leaves it touches or whose cut it may have
changed, cuts them anew, and updates the sums above them. build_trees() stores the leaves and their counts, a row a
document; edit_trees() applies a batch of edits to stored ones and returns the trees after it; count_tokens() is both.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where pre-tokens end for patterns whose tokens are an optional space and then letters, digits or other signs alone, and
#: white space: between such runs and before white space that joins no run, but not after an apostrophe ('s is one token)
#: and not inside or after white space. A run of letters, as in unspaced scripts, is one pre-token and has no cut.
CUT = regex.compile(r"[\p{L}\p{N}](?= \p{L})|\p{L}(?=\p{N})|\p{N}(?=\p{L})|[\p{L}\p{N}](?=[^\s\p{L}\p{N}])|[^\s\p{L}\p{N}'](?=[\p{L}\p{N}])|\S(?=[^\S ])")
LEAF = 1024
#: Characters around a cut that decide it.
CONTEXT = 2


@functools.lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def leaves_of(text: str, size: int = LEAF, cut=CUT) -> list[str]:
    """Leaves of `size` characters and on to the next cut."""
    out, at = [], 0
    while at < len(text):
        m = cut.search(text, at + size - 1)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class TokenTree:
    """chars and sums are heaps: node i has children 2i and 2i + 1, leaf j is node width + j. tokens: the leaves' counts, if known."""

    def __init__(self, leaves: list[str], count, size: int = LEAF, tokens: list[int] | None = None, cut=CUT):
        self.count, self.size, self.cut, self.encoded = count, size, cut, 0
        self._grow(leaves or [""], tokens)

    def _grow(self, leaves: list[str], tokens: list[int | None] | None) -> None:
        self.leaves = leaves
        self.width = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.width), [0] * (2 * self.width)
        for j, leaf in enumerate(leaves):
            self._set(j, leaf, tokens[j] if tokens else None)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _set(self, j: int, leaf: str, tokens: int | None = None) -> None:
        if tokens is None and leaf:
            tokens, self.encoded = self.count(leaf), self.encoded + 1
        self.leaves[j], self.chars[self.width + j], self.sums[self.width + j] = leaf, len(leaf), tokens or 0

    def _sum(self, i: int) -> None:
        self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def stored(self) -> tuple[list[str], list[int]]:
        """The leaves that hold text, and their counts."""
        held = [j for j, leaf in enumerate(self.leaves) if leaf]
        return [self.leaves[j] for j in held], [self.sums[self.width + j] for j in held]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last for the text's end), and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters [start, end). The leaves with the edit or its context are cut and encoded again; the tree is laid out anew only if there are more of them."""
        first, begin = self.find(max(0, start - CONTEXT))
        last, _ = self.find(min(self.chars[1], end + CONTEXT))
        text = "".join(self.leaves[first : last + 1])
        pieces = leaves_of(text[: start - begin] + new + text[end - begin :], self.size, self.cut)
        if len(pieces) > last + 1 - first:
            counts = self.sums[self.width : self.width + len(self.leaves)]
            counts = [*counts[:first], *[None] * len(pieces), *counts[last + 1 :]]
            self._grow([*self.leaves[:first], *pieces, *self.leaves[last + 1 :]], counts)
            return
        touched = set()
        for j in range(first, last + 1):
            self._set(j, pieces[j - first] if j - first < len(pieces) else "")
            touched.add((self.width + j) // 2)
        while touched and max(touched) > 0:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched if i > 1}

    def edit_all(self, edits) -> None:
        """Edits in places of the text before all of them, in order; one that overlaps an earlier one or leaves the text is passed over."""
        shift, free, n = 0, 0, self.chars[1]
        for e in [] if edits is None else edits:
            if free <= e["start"] <= e["end"] <= n:
                self.edit(e["start"] + shift, e["end"] + shift, e["new"] or "")
                shift += len(e["new"] or "") - (e["end"] - e["start"])
                free = e["end"]


def counter(vocabulary: str, pattern: str):
    own = encoding(vocabulary, pattern)
    return lambda t: len(own.encode_ordinary(t))


def build_trees(docs: DataFrame, vocabulary: str, pattern: str, *, key="doc_id", text="text", leaf=LEAF, cut=CUT) -> DataFrame:
    """Per row of docs: key, leaves, tokens (a count a leaf), n_tokens. A null or empty text has no leaves; repeated rows each give their row, an empty table none; a long text has many leaves; other columns are ignored."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary, pattern)
        for texts in batches:
            leaves = [leaves_of(t or "", leaf, cut) for t in texts]
            yield pd.DataFrame({"leaves": leaves, "tokens": [[count(x) for x in some] for some in leaves]})

    built = F.pandas_udf(run, "struct<leaves array<string>, tokens array<int>>")(F.col(text))
    out = docs.select(F.col(key).alias(key), built.alias("t")).select(key, "t.*")
    return out.withColumn("n_tokens", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x))


def edit_trees(trees: DataFrame, edits: str, vocabulary: str, pattern: str, *, leaf=LEAF, cut=CUT) -> DataFrame:
    """Applies the column `edits` (as count_tokens has it) to trees that build_trees() or this function gave: leaves, tokens and n_tokens are those after it, n_reencoded the leaves encoded again. Untouched leaves are not encoded; other columns stay."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary, pattern)
        for leaves, tokens, changes in batches:
            rows = []
            for own, counts, some in zip(leaves, tokens, changes):
                tree = TokenTree([] if own is None else list(own), count, leaf, None if counts is None else [int(c) for c in counts] or None, cut)
                tree.edit_all(some)
                rows.append((*tree.stored(), tree.tokens, tree.encoded))
            yield pd.DataFrame(rows, columns=["leaves", "tokens", "n_tokens", "n_reencoded"])

    edited = F.pandas_udf(run, "struct<leaves array<string>, tokens array<int>, n_tokens long, n_reencoded long>")("leaves", "tokens", edits)
    kept = [c for c in trees.columns if c not in ("leaves", "tokens", "n_tokens", "n_reencoded", edits)]
    name = "_".join(["edited", *trees.columns])  # no column's name
    return trees.select(*kept, edited.alias(name)).select(*kept, f"`{name}`.*")


def count_tokens(docs: DataFrame, edits: str, vocabulary: str, pattern: str, *, key="doc_id", text="text", leaf=LEAF, cut=CUT) -> DataFrame:
    """Per row of docs: key, n_tokens, n_tokens_edited, n_leaves, n_reencoded.

    edits names a column of docs, array<struct<start int, end int, new string>>: replacements in code points of the original
    text, in order and apart from each other; those that overlap an earlier one or leave the text are passed over. A null or
    empty text has no tokens, null edits change nothing. Repeated rows each give their row, an empty table none; there are
    no ties. A long text has many leaves, and an edit costs its own leaves. Other columns are ignored, whatever their
    names. vocabulary is a tiktoken file that executors can open; cut says where pre-tokens of the pattern end for certain.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary, pattern)
        for texts, changes in batches:
            rows = []
            for t, some in zip(texts, changes):
                tree = TokenTree(leaves_of(t or "", leaf, cut), count, leaf, cut=cut)
                before, built = tree.tokens, tree.encoded
                tree.edit_all(some)
                rows.append((before, tree.tokens, built, tree.encoded - built))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_tokens_edited", "n_leaves", "n_reencoded"])

    counted = F.pandas_udf(run, "struct<n_tokens long, n_tokens_edited long, n_leaves long, n_reencoded long>")
    return docs.select(F.col(key).alias(key), counted(F.col(text), F.col(edits)).alias("c")).select(key, "c.*")

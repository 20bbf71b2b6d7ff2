"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put together in another order, for training on infilling.

A text is a numpy array of code points. Every code point has a class; where neighbouring classes differ is a boundary,
found in one comparison of the array with itself. Ranks among the boundaries, drawn from a hash of the document's key,
are where the text is cut. Rebuilding the text needs no Python: no text that holds a marker is cut, so the markers split
the output into its pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 documents, those from this number on stay plain; of the others, those below SPM put the suffix first.
PLAIN, SPM = 90, 20
#: The white space that parts words.
BLANKS = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def text_of(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """The class of each code point: its place where every one is a unit of its own, blank or not for words, the number of line ends before it for lines."""
    if unit == "char":
        return np.arange(len(points), dtype=np.uint32)
    if unit == "word":
        return np.isin(points, BLANKS)
    if unit == "line":
        return np.cumsum(np.concatenate([[0], points[:-1] == 10]), dtype=np.uint32)
    raise ValueError(f"no such unit: {unit}")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and the text ends: n units have n + 1 boundaries."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]])


def cut(text: str, draws: tuple[int, int, int, int], unit: str) -> tuple[int, str, int | None, int | None, str]:
    """(code points, form, those of prefix and middle, output)."""
    points = code_points(text)
    first, second, third, fourth = draws
    if not text or any(m in text for m in MARKERS) or third % 100 >= PLAIN:
        return len(points), "plain", None, None, text
    ends = boundaries(points, unit)
    a, b = sorted((first % len(ends), second % len(ends)))
    a, b = int(ends[a]), int(ends[b])
    prefix, middle, suffix = (text_of(x) for x in (points[:a], points[a:b], points[b:]))
    p, s, m = MARKERS
    spm = fourth % 100 < SPM
    return len(points), "spm" if spm else "psm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"


def infill(docs: DataFrame, *, key="doc_id", text="text", unit="char", seed=1, keep_row=False) -> DataFrame:
    """Per row of docs: key, n (code points of the text), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output.

    unit: 'char', 'word' (runs of blanks and of other signs) or 'line'; cuts fall on boundaries of units, the ends of the
    text included, and a piece may be empty. The draws are the first four numbers of the sha256 of `seed:key`, so reruns and
    repeated rows agree; a null key draws as an empty one. Null and empty texts, those that hold a marker and a tenth of the
    others stay plain. Long texts are cut whole. An empty table gives an empty result. Other columns of docs, whatever
    their names, are ignored, or come along in the struct `row` with keep_row.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]

    def run(texts: pd.Series, *drawn: pd.Series) -> pd.DataFrame:
        rows = [cut(t, d, unit) for t, d in zip(texts, zip(*(x.tolist() for x in drawn)))]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = F.pandas_udf(run, "struct<n long, form string, prefix_chars long, middle_chars long, output string>")(F.coalesce(F.col(text), F.lit("")), *draws)
    found = docs.select(F.col(key).alias(key), *([F.struct("*").alias("row")] if keep_row else []), made.alias("made"))
    return found.select(key, *(["row"] if keep_row else []), "made.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its pieces in their first order. Null gives null."""
    pieces = F.split(output, "<[PSM]>")
    piece = lambda i: F.element_at(pieces, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(2), piece(4), piece(3))).when(form == "spm", F.concat(piece(3), piece(4), piece(2)))

"""Clusters of integer vectors around centroids, exactly and at scale.

Vectors are kept as blocks: a few thousand of them as one matrix a row of a stored table. Squared distances of a block to
all centroids are |x|^2 - 2 x.c + |c|^2, with one product of matrices in 64-bit floats. As long as every number in it is
an integer below 2^53, the floats hold it exactly, in whatever order BLAS adds; rows beyond that bound are taken in Python's
integers instead. Sums and counts of the clusters come together by RDD.treeAggregate, in integers too, so the result does
not depend on how the vectors are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from marlstone.llm.shared import store

#: Vectors a block at most.
BLOCK = 4096
#: Integers up to here are exact as 64-bit floats.
EXACT = 1 << 53


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as int64 where all results fit into 32 bits, else as Python's integers. scale is a power of two, so the product of floats is exact unless it overflows."""
    if not values.size or np.abs(values).max() < 2**31 / scale:
        return np.floor(values * scale).astype(np.int64)
    whole = lambda x: int(np.floor(x * scale)) if abs(x) < EXACT else int(x) * scale
    return np.array([[whole(x) for x in row] for row in values.tolist()], dtype=object)


def magnitude(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


class Centroids:
    """Centroids as integers, and as floats for the product."""

    def __init__(self, rows: list[list[int]]):
        self.exact = np.array(rows, dtype=object).reshape(len(rows), -1)
        self.most = magnitude(self.exact)
        self.floats = self.exact.astype(float) if self.most < EXACT else None
        self.squares = np.array([sum(c * c for c in row) for row in rows], dtype=object)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The number of each row's nearest centroid, the smaller one on ties, and the squared distances as Python's integers."""
        if not len(x):
            return np.zeros(0, np.int64), []
        # |x|^2, |c|^2 and x.c are at most width * most^2; what is added up is at most four times that.
        most = max(self.most, magnitude(x))
        if 4 * x.shape[1] * most * most < EXACT and self.floats is not None:
            v = x.astype(float)
            d = (v * v).sum(1)[:, None] - 2.0 * (v @ self.floats.T) + self.squares.astype(float)[None, :]
            at = d.argmin(1)
            return at, d[np.arange(len(x)), at].astype(np.int64).tolist()
        big = np.array([magnitude(row) for row in x], dtype=object)
        fits = np.array([4 * x.shape[1] * max(self.most, m) ** 2 < EXACT for m in big], dtype=bool)
        at, out = np.zeros(len(x), np.int64), [0] * len(x)
        if fits.any():
            found, near = self.nearest(x[fits].astype(np.int64))
            at[fits] = found
            for i, d in zip(np.flatnonzero(fits).tolist(), near):
                out[i] = d
        for i in np.flatnonzero(~fits).tolist():
            row = [int(c) for c in x[i]]
            squares = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in self.exact]
            out[i] = min(squares)
            at[i] = squares.index(out[i])
        return at, out


class Sums:
    """What the rows of some blocks add up to, cluster by cluster; Python's integers never overflow."""

    def __init__(self, k: int, width: int):
        self.counts = np.zeros(k, np.int64)
        self.inertia = np.zeros(k, dtype=object)
        self.sums = np.zeros((k, width), dtype=object)

    def add(self, x: np.ndarray, at: np.ndarray, distances: list[int]) -> Sums:
        for c in np.unique(at).tolist():
            mine = at == c
            # A block holds BLOCK rows: int64 sums of 32-bit values are exact.
            self.sums[c] += np.array([int(v) for v in x[mine].sum(0)], dtype=object)
        self.counts += np.bincount(at, minlength=len(self.counts))
        for c, d in zip(at.tolist(), distances):
            self.inertia[c] += d
        return self

    def merge(self, other: Sums) -> Sums:
        self.counts += other.counts
        self.inertia += other.inertia
        self.sums += other.sums
        return self


def vectors_in(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, values): which rows are vectors of exactly `width` components, all finite, and those rows as a matrix of floats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    kept = lengths == width
    flat = column.filter(pa.array(kept)).flatten().cast(pa.float64())
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    fine = np.isfinite(values).all(1)
    kept[np.flatnonzero(kept)[~fine]] = False
    return kept, values[fine]


def to_blocks(width: int, scale: int, vector: str):
    """Rows of (n, big, data): 32-bit integers where they fit, else decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values = vectors_in(batch.column(vector), width)
            for begin in range(0, len(values), BLOCK):
                x = integers(values[begin : begin + BLOCK], scale)
                big = x.dtype == object
                data = ",".join(str(c) for row in x for c in row).encode() if big else x.astype("<i4").tobytes()
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int32()), "big": pa.array([big]), "data": pa.array([data], pa.binary())})

    return run


def block_of(row, width: int) -> np.ndarray:
    if row.big:
        return np.array([int(c) for c in bytes(row.data).decode().split(",")], dtype=object).reshape(-1, width)
    return np.frombuffer(row.data, "<i4").reshape(-1, width).astype(np.int64)


def assign_rows(model: Centroids, per_row: dict[str, list], width: int, scale: int, key: str, vector: str, schema: pa.Schema):
    """Rows of key, cluster, distance and what is known of the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = vectors_in(batch.column(vector), width)
            at, distances = [], []
            for begin in range(0, len(values), BLOCK):
                found, near = model.nearest(integers(values[begin : begin + BLOCK], scale))
                at += found.tolist()
                distances += near
            columns = [batch.column(key).filter(pa.array(kept)), pa.array(at, pa.int32()), pa.array([long_or_null(d) for d in distances], pa.int64())]
            columns += [pa.array([per_row[name][c] for c in at], schema.field(name).type) for name in ("cluster_inertia", "inertia", "centroid_sha256")]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def long_or_null(n: int) -> int | None:
    return int(n) if n < 1 << 63 else None


def centroid_clusters(vectors: DataFrame, *, key="vec_id", vector="embedding", width=64, scale=256, clusters=40, rounds=5, seed=2) -> DataFrame:
    """Per kept row of vectors: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `width` components, none null or not finite; each component x counts as floor(scale * x). The
    first centroids are the kept vectors with the smallest sha256 of `seed:key` (null key: empty; ties by the vector itself), in that
    order; fewer kept vectors give fewer clusters. Each of `rounds` rounds assigns every vector to its nearest centroid
    (ties: the smaller number) and moves every centroid that has any to the floor of their mean; then all are assigned
    once more. Squared distances and their sums are exact; one beyond 64 bits is null. Repeated rows count as often as they
    are there. Long vectors, like short ones, are left out. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Only the centroids and what sums up their clusters reach the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast(ArrayType(DoubleType())).alias("vector"))
    shape = StructType().add("key", rows.schema["key"].dataType)
    result = shape.add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long").add("centroid_sha256", "string")

    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    first = rows.filter((F.size("vector") == width) & finite).select(named.alias("hash"), "vector").orderBy("hash", "vector").limit(clusters).collect()
    centroids = [[int(c) for c in integers(np.array([r.vector]), scale)[0]] for r in first]
    if not centroids:
        return spark.createDataFrame([], result).withColumnRenamed("key", key)

    blocks = store(rows.select("vector").mapInArrow(to_blocks(width, scale, "vector"), "n int, big boolean, data binary"), "vector-blocks")
    k = len(centroids)

    def summed(model: Centroids) -> Sums:
        step = lambda sums, row: sums.add(x := block_of(row, width), *model.nearest(x))
        return blocks.rdd.treeAggregate(Sums(k, width), step, Sums.merge, depth=2)

    for _ in range(rounds):
        total = summed(Centroids(centroids))
        centroids = [[int(s) // int(n) for s in row] if n else old for row, n, old in zip(total.sums.tolist(), total.counts.tolist(), centroids)]
    model = Centroids(centroids)
    inertia = [int(d) for d in summed(model).inertia]
    whole = long_or_null(sum(inertia))
    known = {"cluster_inertia": [long_or_null(d) for d in inertia], "inertia": [whole] * k, "centroid_sha256": [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]}
    from pyspark.sql.pandas.types import to_arrow_schema

    out = rows.mapInArrow(assign_rows(model, known, width, scale, "key", "vector", to_arrow_schema(result)), result)
    return out.withColumnRenamed("key", key)

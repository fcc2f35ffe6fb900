"""Linear algebra on tables of long vectors: sums over partitions, scaling, and principal components without a matrix of components x components.

Partial results are matrices, one a partition; they are added up in two levels, so the
driver gets about the square root of the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec

Matrices = list[np.ndarray]


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array column that are not null, as doubles; they have one length."""
    known = len(column) - column.null_count
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(known, -1) if known else np.zeros((0, 0))


def _packed(found: Matrices) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([[x.astype(float).tobytes() for x in found]], pa.list_(pa.binary())), pa.array([[list(x.shape) for x in found]], pa.list_(pa.list_(pa.int64())))], names=["parts", "shapes"])


def _unpacked(parts, shapes) -> Matrices:
    return [np.frombuffer(p, float).reshape(s) for p, s in zip(parts, shapes, strict=True)]


def summed(df: DataFrame, vector: str, partial: Callable[[np.ndarray], Matrices], add: Callable[[Matrices, Matrices], Matrices]) -> Matrices | None:
    """`partial` of the vectors of every batch, put together by `add`: in the partition, over groups of partitions, on the driver. None of no vectors."""
    schema = "parts array<binary>, shapes array<array<long>>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                found = partial(x)
                total = found if total is None else add(total, found)
        if total is not None:
            yield _packed(total)

    rows = df.select(vec.as_double(vector).alias("v")).filter("v is not null").mapInArrow(first, schema)
    return _add_packed(rows, add, rows.rdd.getNumPartitions())


def _add_packed(rows: DataFrame, add: Callable[[Matrices, Matrices], Matrices], parts: int) -> Matrices | None:
    """Packed matrices, of each of `parts` partitions a row, put together: over groups of partitions, then on the driver."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                found = _unpacked(row["parts"], row["shapes"])
                total = found if total is None else add(total, found)
        if total is not None:
            yield _packed(total)

    groups = max(1, int(parts**0.5))
    if groups > 1:
        rows = rows.repartition(groups).mapInArrow(again, "parts array<binary>, shapes array<array<long>>")
    total = None
    for r in rows.collect():  # a row a group, of a size that the vectors' length sets
        found = _unpacked(r.parts, r.shapes)
        total = found if total is None else add(total, found)
    return total


def _moments(x: np.ndarray) -> Matrices:
    mean = x.mean(0)
    return [np.array([len(x)]), mean, ((x - mean) ** 2).sum(0)]


def _add_moments(a: Matrices, b: Matrices) -> Matrices:
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return [n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap**2 * (a[0] * b[0] / n)]


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and sum of squared differences from it, by component."""
    found = summed(df, vector, _moments, _add_moments)
    return (int(found[0][0]), found[1], found[2]) if found else (0, np.zeros(0), np.zeros(0))


def mapped(df: DataFrame, vector: str, fn: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """df with fn of its vectors, a batch at a time; null stays null."""
    place = df.columns.index(vector)
    fields = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    keep = [i for i, f in enumerate(df.schema.fields) if f.name != out]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            known = np.asarray(column.is_valid())
            y = fn(_matrix(column)) if known.any() else np.zeros((0, 0))
            ends = np.concatenate([[0], np.cumsum(np.where(known, y.shape[1], 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), lists], names=[f.name for f in schema])

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(each, schema)


def scaled(df: DataFrame, vector: str, out: str) -> DataFrame:
    """df with its vectors less their mean, over their deviation (of the rows; 1 where it is 0): one sum over partitions, no shuffle of components."""
    n, mean, square = moments(df, vector)
    sd = np.sqrt(square / max(n, 1))
    shared = df.sparkSession.sparkContext.broadcast((mean, np.where(sd > 0, sd, 1.0)))
    return mapped(df, vector, lambda x: (x - shared.value[0]) / shared.value[1], out)


def _triangle(y: np.ndarray) -> Matrices:
    return [np.linalg.qr(y, mode="r")]


def _add_triangles(a: Matrices, b: Matrices) -> Matrices:
    return [np.linalg.qr(np.vstack([a[0], b[0]]), mode="r")]


def principal(df: DataFrame, vector: str, k: int, over: int | None = None, rounds: int = 4, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components x k, shares of the variance), the largest first.

    A random subspace somewhat wider than k is turned towards the rows' principal
    directions in `rounds` passes, each a sum of d x (k + over) numbers; the rows'
    coordinates in it are a tall and thin matrix, whose triangle comes from a QR
    decomposition in every partition. Where the subspace is all there is, no pass
    is needed and the result is exact.
    """
    n, mean, square = moments(df, vector)
    d, total = len(mean), float(square.sum())
    if not n or not total:
        return mean, np.eye(d)[:, : min(k, d)], np.zeros(min(k, d))
    wide = min(d, k + (max(k, 24) if over is None else over))
    sc = df.sparkSession.sparkContext
    basis = np.eye(d) if wide == d else np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]
    for _ in range(rounds if wide < d else 0):
        shared = sc.broadcast((mean, basis))

        def turned(x: np.ndarray, shared=shared) -> Matrices:
            middle, now = shared.value
            c = x - middle
            return [c.T @ (c @ now)]

        basis = np.linalg.qr(summed(df, vector, turned, lambda a, b: [a[0] + b[0]])[0])[0]
    shared = sc.broadcast((mean, basis))
    triangle = summed(df, vector, lambda x: _triangle((x - shared.value[0]) @ shared.value[1]), _add_triangles)[0]
    _, values, turn = np.linalg.svd(triangle, full_matrices=False)
    parts = basis @ turn.T
    parts = parts * np.where(parts[np.abs(parts).argmax(0), np.arange(parts.shape[1])] < 0, -1, 1)  # the largest number of a component is positive
    return mean, parts[:, :k], (values**2 / total)[:k]


def pca(df: DataFrame, vector: str, n: int | None = None, most: int = 50, share: float = 0.9, fit_on=None, out: str = "reduced") -> DataFrame:
    """Principal components: n of them, or as few as hold `share` of the variance (2 at least, `most` at most). fit_on: the rows to learn from."""
    learn = df.filter(fit_on) if fit_on is not None else df
    k = n or min(most, max(1, learn.limit(most + 1).count()))
    mean, parts, shares = principal(learn, vector, k)
    if n is None:
        k = max(min(2, parts.shape[1]), min(parts.shape[1], int(np.searchsorted(np.cumsum(shares), share)) + 1))
    shared = df.sparkSession.sparkContext.broadcast((mean, parts[:, :k]))
    return mapped(df, vector, lambda x: (x - shared.value[0]) @ shared.value[1], out)

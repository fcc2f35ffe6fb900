"""Feed-forward networks fitted on partitions side by side: relu layers, minibatch Adam, early stopping.

An epoch is one Spark job. Every partition starts from the epoch's weights and Adam's
moments, takes its own minibatches in a shuffled order, and hands on what it reached; the
partitions' results are averaged by their rows, in two levels, and start the next
epoch. Held-out rows are scored by the epoch's first weights in the same job. So a lost
executor costs a part of one epoch, the driver holds a model and never rows, and one
partition alone is plain minibatch Adam.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec
from .linear import _add_packed, _matrix
from .persist import cut

#: Rows of a partition, at least: fewer would make its steps too noisy to average.
LEAST_ROWS = 4096
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8

Layers = list[np.ndarray]


def start_layers(sizes: Sequence[int], rng: np.random.Generator) -> Layers:
    """Weights and constants, uniform within the bound that keeps a layer's spread."""
    out: Layers = []
    for n, m in zip(sizes[:-1], sizes[1:], strict=True):
        bound = (6.0 / (n + m)) ** 0.5
        out += [rng.uniform(-bound, bound, (n, m)), rng.uniform(-bound, bound, m)]
    return out


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The input, every hidden layer after relu, and the probabilities."""
    seen = [x]
    for i in range(0, len(layers), 2):
        z = seen[-1] @ layers[i] + layers[i + 1]
        if i + 2 < len(layers):
            z = np.maximum(z, 0)
        else:
            z = np.exp(z - z.max(1, keepdims=True))
            z = z / z.sum(1, keepdims=True)
        seen.append(z)
    return seen


def gradients(layers: Layers, x: np.ndarray, y: np.ndarray, decay: float) -> Layers:
    """Of the mean log loss plus half of decay times the squared weights over the rows."""
    seen = forward(layers, x)
    d = seen[-1].copy()
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    out: Layers = []
    for i in range(len(layers) - 2, -1, -2):
        before = seen[i // 2]
        out = [before.T @ d + decay / len(y) * layers[i], d.sum(0), *out]
        if i:
            d = (d @ layers[i].T) * (before > 0)
    return out


def epoch(state: dict, x: np.ndarray, y: np.ndarray, batch: int, rate: float, decay: float, rng: np.random.Generator) -> dict:
    """The state (weights, both moments, steps) after one pass over the rows in minibatches."""
    layers, first, second, t = ([a.copy() for a in state["layers"]], [a.copy() for a in state["first"]], [a.copy() for a in state["second"]], state["t"])
    order = rng.permutation(len(y))
    for at in range(0, len(y), batch):
        rows = order[at : at + batch]
        t += 1
        step = rate * (1 - BETA2**t) ** 0.5 / (1 - BETA1**t)
        for w, m, v, g in zip(layers, first, second, gradients(layers, x[rows], y[rows], decay), strict=True):
            m += (1 - BETA1) * (g - m)
            v += (1 - BETA2) * (g * g - v)
            w -= step * m / (np.sqrt(v) + TINY)
    return {"layers": layers, "first": first, "second": second, "t": t}


class Network:
    """Fitted layers, and the loss of the held-out rows before each epoch."""

    def __init__(self, layers: Layers, losses: Sequence[float] = ()):
        self.layers, self.losses = layers, list(losses)

    @property
    def sizes(self) -> list[int]:
        return [self.layers[0].shape[0], *(b.shape[0] for b in self.layers[1::2])]

    @classmethod
    def fit(
        cls, df: DataFrame, vector: str, label: str, classes: int, hidden: Sequence[int] = (512, 128), epochs: int = 200, rate: float = 1e-3, batch: int = 200,
        decay: float = 1e-4, held: float = 0.1, patience: int = 10, tolerance: float = 1e-4, partitions: int | None = None, seed: int = 42,
    ) -> Network:
        """label: class numbers from 0. A share `held` of the rows, by a hash, is not learned from; when its loss hasn't fallen by `tolerance` for `patience` epochs, fitting stops, and the best weights stay."""
        rows = df.select(vec.as_double(vector).alias("x"), F.col(label).cast("int").alias("y")).filter("x is not null and y is not null")
        share = F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(1 << 20)) / float(1 << 20)  # equal rows are on one side
        rows = rows.withColumn("out", share < held)
        n, outside, size = rows.agg(F.count(F.lit(1)), F.count_if("out"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to learn from")
        if outside in (0, n):
            rows = rows.withColumn("out", F.lit(None).cast("boolean"))  # too few rows for two sides: all are on both
        parts = partitions or max(1, min(rows.rdd.getNumPartitions(), n // LEAST_ROWS))
        rows = cut(rows.repartition(parts, F.xxhash64(F.lit(seed + 1), "x")))
        rng = np.random.default_rng(seed)
        layers = start_layers([size, *hidden, max(2, classes)], rng)
        state = {"layers": layers, "first": [np.zeros_like(a) for a in layers], "second": [np.zeros_like(a) for a in layers], "t": 0}
        best, best_loss, waited, losses = layers, np.inf, 0, []
        for number in range(epochs + 1):
            shared = rows.sparkSession.sparkContext.broadcast(state)  # of the model's size
            found = _add_packed(rows.mapInArrow(_pass(shared, batch, rate, decay, [seed, number], number < epochs), "parts array<binary>, shapes array<array<long>>"), lambda a, b: [p + q for p, q in zip(a, b, strict=True)], parts)
            shared.unpersist()
            (learned, scored, loss, t), sums = found[0], found[1:]
            losses.append(float(loss / max(scored, 1)))
            if losses[-1] < best_loss - tolerance:
                waited = 0
            else:
                waited += 1
            if losses[-1] < best_loss:
                best, best_loss = state["layers"], losses[-1]
            if waited >= patience or number == epochs:
                break
            k = len(layers)
            mean = [a / learned for a in sums]
            state = {"layers": mean[:k], "first": mean[k : 2 * k], "second": mean[2 * k :], "t": int(round(t / learned))}
        return cls(best, losses)

    def probabilities(self, df: DataFrame, vector: str, out: str, normalise: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
        """df, or its columns `keep`, with the classes' probabilities, in single precision: matrix products over Arrow batches. A null vector has none.

        Long vectors cost less to read than to hand back: without them in `keep` only the others return. They cost
        still less as binary columns of `packed`, which are moved as they are and not number by number.
        """
        shared = df.sparkSession.sparkContext.broadcast([a.astype(np.float32) for a in self.layers])
        place, last = df.columns.index(vector), self.sizes[-1]
        kept = [i for i, c in enumerate(df.columns) if keep is None or c in keep]
        schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out, T.ArrayType(T.DoubleType()))])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(place)
                known = np.asarray(column.is_valid())
                p = np.zeros((0, last))
                if known.any():
                    x = _singles(column, int(known.sum()))
                    if normalise:
                        norms = np.linalg.norm(x, axis=1, keepdims=True)
                        x = x / np.where(norms > 0, norms, 1)
                    p = forward(shared.value, x)[-1]
                ends = np.concatenate([[0], np.cumsum(np.where(known, last, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(p.astype(float).ravel()), mask=pa.array(~known))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), lists], names=[f.name for f in schema])

        return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(each, schema)

    def save(self, path: str) -> None:
        """A row for each matrix, in order, and the losses with the first."""
        rows = [(i, list(a.shape), a.astype(float).tobytes(), json.dumps(self.losses) if not i else None) for i, a in enumerate(self.layers)]
        SparkSession.active().createDataFrame(rows, "place int, shape array<long>, body binary, losses string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        rows = spark.read.parquet(path).orderBy("place").collect()
        return cls([np.frombuffer(bytes(r["body"]), float).reshape(r["shape"]) for r in rows], json.loads(rows[0]["losses"] or "[]"))


def _singles(column: pa.Array, known: int) -> np.ndarray:
    """The vectors that are not null, in single precision, of arrays or of packed bytes."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.drop_null().to_pylist()), "<f4").reshape(known, -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(known, -1)


def packed(df: DataFrame, vector: str, out: str) -> DataFrame:
    """df with a vector column as bytes of single precision, little end first; null stays null."""
    place = df.columns.index(vector)
    kept = [i for i, c in enumerate(df.columns) if c != out]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out, T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            known = np.asarray(column.is_valid())
            rows = iter(_singles(column, int(known.sum())).astype("<f4") if known.any() else ())
            bodies = [next(rows).tobytes() if k else None for k in known]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(bodies, pa.binary())], names=[f.name for f in schema])

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(each, schema)


def _pass(shared, batch: int, rate: float, decay: float, seed: list[int], learn: bool):
    """Of a partition one row: learned and held-out rows, their loss and the steps, and the state it reached, times the rows it learned from."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        xs, ys, outs = [], [], []
        for b in batches:
            if b.num_rows:
                xs.append(_matrix(b.column(0)))
                ys.append(b.column(1).to_numpy())
                outs.append(np.array(b.column(2).to_pylist(), object))
        if not xs:
            return
        x, y, side = np.vstack(xs), np.concatenate(ys), np.concatenate(outs)
        inside = np.array([s is not True for s in side])
        scored = np.array([s is not False for s in side])
        state = shared.value
        p = forward(state["layers"], x[scored])[-1] if scored.any() else np.zeros((0, 1))
        loss = -np.log(np.maximum(p[np.arange(len(p)), y[scored]], 1e-15)).sum() if len(p) else 0.0
        part = TaskContext.get().partitionId()
        if learn and inside.any():
            state = epoch(state, x[inside], y[inside], batch, rate, decay, np.random.default_rng([*seed, part]))
        n = int(inside.sum())
        found = [np.array([n, scored.sum(), loss, state["t"] * n], float), *(a * n for name in ("layers", "first", "second") for a in state[name])]
        yield pa.RecordBatch.from_arrays([pa.array([[a.astype(float).tobytes() for a in found]], pa.list_(pa.binary())), pa.array([[list(a.shape) for a in found]], pa.list_(pa.list_(pa.int64())))], names=["parts", "shapes"])

    return each

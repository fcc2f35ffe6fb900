"""All pairs of two row sets as numpy blocks: packed rows meet in blocks of bounded size, and each block returns reduced rows only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and numbers of a block at most, rows of a packed row, and blocks of the right side that a task holds.
BLOCK, NUMBERS, PACK, HELD = 1 << 15, 1 << 21, 4096, 4
#: Blocks of small sides, if they keep LEAST rows: so many tasks are worth their start.
SPREAD, LEAST = 16, 2048
#: Rows of both sides of which the products are held at once, in a processor's cache.
TILE = (128, 4096)


def packed(df: DataFrame, vector: str, parts: int) -> DataFrame:
    """(at, each other column as an array, vector binary): rows dealt over `parts` blocks, numbered by `at`; a packed row has PACK rows at most, vectors of one length and none null."""
    kind = df.schema[vector].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    others = [f for f in df.schema.fields if f.name != vector]
    schema = T.StructType([T.StructField("at", T.IntegerType()), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in others), T.StructField(vector, T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, PACK):
                part = batch.slice(start, PACK)
                ends = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, part.column(i)) for i in range(len(others))]
                flat = part.column(len(others)).flatten().to_numpy(zero_copy_only=False).astype(dtype)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *lists, pa.array([flat.tobytes()], pa.binary())], names=[f.name for f in schema])

    return df.select(*(f.name for f in others), vector).repartition(parts).mapInArrow(each, schema)


def unpacked(table: pa.Table, name: str) -> np.ndarray:
    """A column of packed rows, end to end."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def vectors_of(table: pa.Table, name: str, rows: int, single: bool) -> np.ndarray:
    """The vectors of packed rows, as doubles."""
    parts = [np.frombuffer(v.as_buffer(), "<f4" if single else "<f8") for v in table.column(name)]
    flat = np.concatenate(parts).astype(float) if parts else np.zeros(0)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 1)


def block_pairs(left: DataFrame, right: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str, vectors: tuple[str, str], components: int, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """fn(a block of left, `held` blocks of right) until every two rows have met: both of `packed` rows; schema is what fn returns."""
    most = max(1, min(block, NUMBERS // max(1, components)))
    blocks = lambda n: max(1, -(-n // most), min(SPREAD, n // LEAST))
    l, r = blocks(left.count()), -(-right.count() // most) or 1
    groups = -(-r // held)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    lhs = packed(left, vectors[0], l).withColumnRenamed("at", "_i").withColumn("_j", every(groups))
    rhs = packed(right, vectors[1], r).withColumn("_j", F.pmod("at", F.lit(groups))).drop("at").withColumn("_i", every(l))
    return lhs.groupBy("_i", "_j").cogroup(rhs.groupBy("_i", "_j")).applyInArrow(lambda x, y: fn(x, y), schema)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def set_bits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix of truths with few of them: eight are looked at together."""
    rows, columns = mask.shape
    pad = -columns % 8
    if pad:
        mask = np.pad(mask, ((0, 0), (0, pad)))
    words = np.flatnonzero(np.ascontiguousarray(mask).view(np.uint64))
    at, bit = np.nonzero(mask.reshape(-1, 8)[words])
    return np.divmod(words[at] * 8 + bit, columns + pad)


def places(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each id stands among distinct sorted ones; -1: nowhere."""
    if not len(among):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(among, ids), len(among) - 1)
    return np.where(among[at] == ids, at, -1)

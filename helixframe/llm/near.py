"""What near-duplicate operators on sets of word shingles share: sets, their digests, and linking what meets in buckets.

A node is a distinct set of shingles. Nodes that share a bucket are linked in two passes,
so that a group of thousands of near copies needs no list of its pairs:

1. A star: in every bucket each node meets one pivot, the node with the most company in
   all its buckets, which is the middle of its group.
2. Only buckets that still hold two components are looked at again. Those with the same
   pivot are one unit, in which a node comes once, however many buckets it shares with the
   others. In a unit every pair of nodes of different components is compared by what the
   operator carries of them, in cells of at most `CELL` nodes a side, and told in the first
   unit that both are in. Those near enough are confirmed on the full sets like the others.

So no pair that shares a bucket is left out unless its ends are already linked through
others, and what a unit emits are near misses and links, not its pairs. Comparing
in cells does grow with the square of a unit whose nodes stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, small_side
from .components import components

#: Nodes of a bucket that are compared in one cell, a side.
CELL = 1024

Pairs = tuple[np.ndarray, np.ndarray]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(r, 42) for r in runs), np.uint64))


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def node_sets(needed: DataFrame, df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(node, x): the full sets of nodes (node, h, least), read again from the document of the smallest id of each."""
    small = small_side(needed.select(F.col("least").alias("_least")).distinct(), needed.count(), 24)
    src = df.select(F.col(key).alias("id"), F.col(text).alias("t"))
    src = src.join(small, F.col("id").eqNullSafe(F.col("_least")), "left_semi").select("t")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s for t in batch.column(0) if len(s := shingle_hashes(t.as_py(), shingle))]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["h", "x"])

    return src.mapInArrow(each, "h binary, x array<long>").join(needed.select("node", "h"), "h").dropDuplicates(["node"]).select("node", "x")


def confirmed(pairs: DataFrame, nodes: DataFrame, df: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose full sets have a similarity of `percent` or more."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("u").alias("node")).distinct().unionByName(pairs.select(F.col("v").alias("node")).distinct()).distinct()  # summed before they move
    needed = cut(ends.join(nodes.select("node", "h", "least"), "node"))
    sets = cut(node_sets(needed, df, key, text, shingle))
    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("x").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("x").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return cut(met.filter(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v"))


def company(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, many) of every node and bucket (by) that holds `many`, two or more."""
    sizes = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    return cut(rows.join(small_side(sizes, sizes.count(), 32), by).select(*by, "node", "many"))


def star_pairs(met: DataFrame, by: list[str], fullest: int | None = None) -> DataFrame:
    """(u, v), u < v: every node with the pivot of each of its buckets, or of its `fullest` ones: the node that has the most company in all of its own."""
    weights = met.groupBy("node").agg(F.sum("many").alias("w"))
    pivots = met.join(weights, "node").groupBy(*by).agg(F.max_by("node", F.struct("w", "node")).alias("pivot"))
    if fullest:
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("many"), *by))  # of a node's own buckets
        met = met.withColumn("place", place).filter(F.col("place") <= fullest).drop("place")
    pairs = met.join(pivots, by).filter("node <> pivot")
    return pairs.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()


def units_of(met: DataFrame, by: list[str], found: DataFrame) -> DataFrame:
    """(unit, node, root), each once: the nodes of the buckets that hold two components of found (node, root), by the pivots of the buckets."""
    info = met.groupBy("node").agg(F.sum("many").alias("w")).join(found, "node", "left").select("node", "w", F.coalesce("root", "node").alias("root"))
    bucket = Window.partitionBy(*by)
    rows = met.join(info, "node").select(
        "node", "root", F.max_by("node", F.struct("w", "node")).over(bucket).alias("unit"), F.min("root").over(bucket).alias("lo"), F.max("root").over(bucket).alias("hi")
    )
    return rows.filter("lo < hi").select("unit", "node", "root").distinct()


def apart_pairs(met: DataFrame, by: list[str], found: DataFrame, carried: DataFrame, compare: Callable[[pa.Table], Pairs], cell: int = CELL) -> DataFrame:
    """(u, v) of one unit in different components of found (node, root) that `compare` tells of a cell: rows unit, i, j, s, node, root and what is carried of nodes."""
    units = cut(units_of(met, by, found))
    own = units.groupBy("node").agg(F.sort_array(F.collect_list("unit")).alias("units"))  # a bucket of the node each, at most
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("unit")) / cell).cast("int")
    rows = units.withColumn("parts", parts).withColumn("s", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("unit", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "s", "node", "root")
    names = ["unit", "i", "j"]
    rows = rows.join(carried.join(own, "node"), "node").select(*names, "s", "node", "root", "units", *(c for c in carried.columns if c != "node")).repartition(*names).sortWithinPartitions(*names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, len(names)):
            u, v = first_met(run, *compare(run))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return rows.mapInArrow(each, "u long, v long")


def first_met(run: pa.Table, u: np.ndarray, v: np.ndarray) -> Pairs:
    """The pairs of a cell whose ends are in no earlier unit together."""
    unit = run.column("unit")[0].as_py()
    lists = run.column("units").combine_chunks()
    many = np.diff(lists.offsets.to_numpy())
    before = np.full((len(lists), max(many, default=0)), np.iinfo(np.int64).max)
    before[np.arange(before.shape[1]) < many[:, None]] = lists.flatten().to_numpy()
    node = run.column("node").to_numpy()
    order = np.argsort(node)
    at = lambda x: order[np.searchsorted(node, x, sorter=order)]
    a, b = at(u), at(v)
    told = np.ones(len(u), bool)
    starts = np.argsort(a, kind="stable")
    for rows in np.split(starts, np.flatnonzero(np.diff(a[starts])) + 1):
        if len(rows):
            earlier = before[a[rows[0]]]
            earlier = earlier[earlier < unit]
            if len(earlier):
                told[rows] = ~np.isin(before[b[rows]], earlier).any(1)
    return u[told], v[told]


def others_of(run: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a cell: each row of its left side with those of its right side that are in other components, each pair once."""
    i, j = (run.column(c)[0].as_py() for c in ("i", "j"))
    s, node, root = (run.column(c).to_numpy() for c in ("s", "node", "root"))
    right = np.flatnonzero(s == j)
    for a in np.flatnonzero(s == i):
        others = right[(root[right] != root[a]) & ((node[right] > node[a]) | (i != j))]
        if len(others):
            yield int(a), others


def matrix(run: pa.Table, name: str, width: int) -> np.ndarray:
    return run.column(name).combine_chunks().flatten().to_numpy().reshape(-1, width)


def paired(run: pa.Table, found: list[tuple[int, np.ndarray]]) -> Pairs:
    """The nodes of (row, rows)."""
    node = run.column("node").to_numpy()
    if not found:
        return node[:0], node[:0]
    return np.concatenate([np.full(len(o), node[a]) for a, o in found]), np.concatenate([node[o] for _, o in found])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows that share their first columns, which are sorted by them: a run may reach over batches, but ends within a cell's rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(keys)])
        starts = np.concatenate([[0], np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and (cols[:, a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = cols[:, a]
    if held:
        yield pa.Table.from_batches(held)


def linked(met: DataFrame, by: list[str], verify: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame], DataFrame], carried: DataFrame, compare: Callable[[pa.Table], Pairs], cell: int = CELL, fullest: int | None = None) -> DataFrame:
    """(node, root): the components of the links among what meets, by both passes. fullest: buckets of a node that the first pass takes; the second takes all."""
    found = cut(components(confirm(verify(star_pairs(met, by, fullest)))))
    more = confirm(apart_pairs(met, by, found, carried, compare, cell))
    return components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def classes(nodes: DataFrame, joined: DataFrame) -> tuple[DataFrame, int]:
    """(h, component_id) of the sets that more than one row has or that have a link, and how many those are; nodes: (node, h, least, copies)."""
    known = nodes.join(joined, "node", "left").filter("root is not null or copies > 1").select("h", "least", F.coalesce("root", "node").alias("root"))
    known = cut(known)
    return known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h", "component_id"), known.count()

"""Blocks of long sequences: places, totals and frames without a sequence in one task.

Rows are (sequence, position, ...), positions numbers, distinct in a sequence. A sequence
is cut into blocks of positions; a table with a row for each block carries counts and
totals across, so the places of all rows come from one shuffle by (sequence, block).
Frames are then computed in blocks of places: a row is copied to the neighbouring
blocks whose frames reach it (a halo), so every frame finds its rows in its own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block, and places of a frame's block.
WIDTH = 1 << 16


def numbered(df: DataFrame, seq: str, pos: str, value: str | Column | None = None, width: int = WIDTH) -> DataFrame:
    """df with _i (place from 0 in its sequence) and _n (the sequence's rows); with a value also _mean and _sd of the whole sequence."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("_b", F.floor(F.col(pos) / width))
    extra = [] if v is None else [F.count(v).alias("_vn"), F.avg(v).alias("_vm"), (F.var_pop(v) * F.count(v)).alias("_v2")]
    blocks = rows.groupBy(F.col(seq).alias("_seq"), F.col("_b").alias("_bb")).agg(F.count(F.lit(1)).alias("_c"), *extra)
    whole = Window.partitionBy("_seq")
    earlier = whole.orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).withColumn("_n", F.sum("_c").over(whole))
    kept = ["_before", "_n"]
    if v is not None:  # the blocks' means and squares, put together without the loss of raw squares
        total = F.sum("_vn").over(whole)
        blocks = blocks.withColumn("_mean", F.try_divide(F.sum(F.col("_vm") * F.col("_vn")).over(whole), total))
        square = F.sum(F.col("_v2") + F.col("_vn") * F.pow(F.col("_vm") - F.col("_mean"), 2)).over(whole)
        blocks = blocks.withColumn("_sd", F.sqrt(F.try_divide(square, total)))
        kept += ["_mean", "_sd"]
    inside = F.row_number().over(Window.partitionBy(seq, "_b").orderBy(pos))
    same = F.col(seq).eqNullSafe(F.col("_seq")) & F.col("_b").eqNullSafe(F.col("_bb"))
    joined = rows.withColumn("_r", inside).join(blocks.select("_seq", "_bb", *kept), same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_r") - 1).alias("_i"), *(c for c in kept if c != "_before"))


def framed(rows: DataFrame, before: int, after: int, reflect: bool = False, width: int = WIDTH) -> DataFrame:
    """Numbered rows by block `_k` of places, with the rows that frames of `before` and `after` rows need from outside as copies (`_own` false).

    reflect: beyond the ends the first and last rows stand again, mirrored.
    """
    width = max(width, 4 * (before + after))
    i, n = F.col("_i"), F.col("_n")
    if reflect:
        mirrored = F.filter(F.array(i, F.when(i < before, -i - 1), F.when(i >= n - after, 2 * n - 1 - i)), lambda x: x.isNotNull())
        rows = rows.withColumn("_real", i).withColumn("_i", F.explode(mirrored))
    else:
        rows = rows.withColumn("_real", i)
    last = F.floor((n - 1) / width)
    first, final = F.greatest(F.floor((i - after) / width), F.lit(0)), F.least(F.floor((i + before) / width), last)
    rows = rows.withColumn("_k", F.explode(F.sequence(first, final)))
    return rows.withColumn("_own", (i == F.col("_real")) & (F.floor(i / width) == F.col("_k")))


def own(rows: DataFrame, *keep: str) -> DataFrame:
    """The rows of framed() that are no copies, without the columns it added, but for those to keep."""
    return rows.filter("_own").drop(*(c for c in ("_i", "_n", "_mean", "_sd", "_real", "_k", "_own") if c not in keep))


def over(seq: str):
    """The window in which frames of framed() are taken."""
    return Window.partitionBy(seq, "_k").orderBy("_i")

"""Windows, regions and interval joins. Coordinates count from 0 and are half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the coordinate bins that turn range joins into equi-joins.
BIN = 4096

from .ordered import running_sums


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tile_starts(length: str | Column, size: int, step: int, tail: str = "aligned") -> Column:
    """Starts of windows over a sequence; one window if it is short.

    tail `aligned`: a last window ends where the sequence does. `step`: a last one
    starts at the next step if the sequence isn't covered.
    """
    n = _col(length)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - size, F.lit(0)).cast("long"), F.lit(step).cast("long"))
    if tail == "aligned":
        more = F.array(F.greatest(n - size, F.lit(0)).cast("long"))
        return F.when(n > 0, F.array_distinct(F.concat(starts, more))).otherwise(F.array().cast("array<bigint>"))
    last = F.element_at(starts, -1)
    return F.when(n > last + size, F.concat(starts, F.array(last + step))).otherwise(starts)


def tile(df: DataFrame, seq_id: str, length: str | Column, size: int, step: int, tail: str = "aligned", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each window: the id, `keep`, start, end, window_id."""
    n = _col(length)
    rows = df.select(seq_id, *keep, n.cast("long").alias("_n"), F.explode(tile_starts(n, size, step, tail)).alias("start"))
    rows = rows.withColumn("end", F.least(F.col("start") + size, F.col("_n"))).drop("_n")
    return rows.withColumn("window_id", F.concat_ws(":", F.col(seq_id).cast("string"), "start", "end"))


def count_windows(length: str | Column, size: int, step: int) -> Column:
    """Estimated windows of a sequence, one at least."""
    return F.greatest(F.lit(1), F.floor((_col(length) - size) / step) + 1).cast("long")


def centred_window(start: str | Column, end: str | Column, length: str | Column, size: int) -> tuple[Column, Column]:
    """(start, end) of a window around the middle of an interval, clipped to the sequence."""
    mid = F.floor((_col(start) + _col(end)) / 2).cast("long")
    return F.greatest(mid - size // 2, F.lit(0)), F.least(mid + size // 2, _col(length).cast("long"))


def islands(df: DataFrame, key: str, start: str = "start", end: str = "end", gap: int = 0, island: str = "island") -> DataFrame:
    """Number the groups of intervals of a key that lie at most `gap` apart: a running maximum of ends, one sort a key."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col(start) - reach > gap)).cast("int")
    return df.withColumn("_new", fresh).withColumn(island, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_regions(df: DataFrame, key: str, score: str, threshold: float, gap: int, min_length: int = 0, start: str = "start", end: str = "end") -> DataFrame:
    """Regions of windows that score at least the threshold: key, start, end, length, n_windows, mean_score, max_score, region_no.

    The number counts, by key and start over all keys, the regions that are long enough.
    """
    hits = df.filter(F.col(score) >= threshold)
    merged = islands(hits, key, start, end, gap).groupBy(key, "island").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n_windows"),
        F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
    )
    kept = merged.drop("island").withColumn("length", F.col("end") - F.col("start")).filter(F.col("length") >= min_length)
    first = running_sums(kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, {"_first": "_n"}, before=True).select(key, "_first")
    own = F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1
    return kept.withColumn("_own", own).join(first, key).withColumn("region_no", (F.col("_first") + F.col("_own")).cast("int")).drop("_own", "_first")


def candidate_regions(df: DataFrame, key: str, length: str, score: str, threshold: float, margin: int, start: str = "start", end: str = "end") -> DataFrame:
    """Union of the hits widened by a margin and clipped to the sequence; regions that touch are one."""
    wide = df.filter(F.col(score) >= threshold).select(
        key, F.greatest(F.col(start) - margin, F.lit(0)).alias("start"), F.least(F.col(end) + margin, F.col(length)).alias("end")
    )
    return islands(wide, key).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def tile_regions(regions: DataFrame, lengths: DataFrame, key: str, length: str, size: int, step: int) -> DataFrame:
    """Windows inside regions only; a window that two regions have comes once."""
    placed = regions.join(lengths.select(key, F.col(length).alias("_len")), key)
    span = F.col("end") - F.col("start")
    rows = placed.select(key, "_len", F.col("start").alias("_from"), F.col("end").alias("_to"), F.explode(tile_starts(span, size, step)).alias("_at"))
    rows = rows.select(key, (F.col("_from") + F.col("_at")).alias("start"), F.least(F.col("_from") + F.col("_at") + size, F.col("_to"), F.col("_len")).alias("end"))
    rows = rows.withColumn("window_id", F.concat_ws(":", F.col(key).cast("string"), "start", "end"))
    return rows.dropDuplicates(["window_id"])


def _binned(df: DataFrame, start: Column, end: Column, width: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width))))


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_start: str, a_end: str, b_start: str, b_end: str, width: int = BIN) -> DataFrame:
    """Pairs of intervals of a key that overlap, with the `overlap`. Column names of a and b differ but for the key.

    Both sides go to the coordinate bins that they touch; a pair is kept in the bin of
    the later start alone, so none comes twice.
    """
    left = _binned(a, F.col(a_start), F.col(a_end), width, "_bin")
    right = _binned(b, F.col(b_start), F.col(b_end), width, "_bin")
    met = left.join(right, [key, "_bin"]).filter((F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)))
    met = met.filter(F.col("_bin") == F.floor(F.greatest(a_start, b_start) / width)).drop("_bin")
    return met.withColumn("overlap", F.least(a_end, b_end) - F.greatest(a_start, b_start))


def near_join(points: DataFrame, others: DataFrame, key: str, at: str, other: str, tolerance: int) -> DataFrame:
    """Pairs of positions of a key at most `tolerance` apart, with the `distance`."""
    width = max(1, tolerance)
    left = points.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(at) / width) + d for d in (-1, 0, 1)))))
    right = others.withColumn("_bin", F.floor(F.col(other) / width))
    return left.join(right, [key, "_bin"]).withColumn("distance", F.abs(F.col(at) - F.col(other))).filter(F.col("distance") <= tolerance).drop("_bin")


def nearest_other(points: DataFrame, others: DataFrame, key: str, at: str, other: str) -> DataFrame:
    """For each position of a key the nearest of the others, the smaller on a tie; without a join: one sort, looking back and ahead."""
    both = points.select(key, F.col(at).alias("_x"), F.lit(True).alias("_p")).unionByName(others.select(key, F.col(other).alias("_x"), F.lit(False).alias("_p")))
    mark = F.when(~F.col("_p"), F.col("_x"))
    order = Window.partitionBy(key).orderBy("_x", F.col("_p").cast("int"))
    back = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_b", back).withColumn("_a", ahead).filter("_p")
    nearer = F.when(F.col("_a").isNull() | (F.col("_x") - F.col("_b") <= F.col("_a") - F.col("_x")), F.col("_b")).otherwise(F.col("_a"))
    return found.select(key, F.col("_x").alias(at), nearer.alias(other), F.abs(F.col("_x") - nearer).alias("distance")).filter(F.col(other).isNotNull())


def reject_masked(fragments: DataFrame, masks: DataFrame, key: str, frag_id: str, most: float = 0.5) -> DataFrame:
    """Fragments (id, key, start, end) with masked_share and `rejected`: masks cover at least `most` of them."""
    over = overlap_join(fragments, masks.select(key, F.col("start").alias("m_start"), F.col("end").alias("m_end")), key, "start", "end", "m_start", "m_end")
    covered = over.groupBy(frag_id).agg(F.sum("overlap").alias("_cov"))
    share = F.coalesce(F.col("_cov"), F.lit(0)) / F.greatest(F.col("end") - F.col("start"), F.lit(1))
    return fragments.join(covered, frag_id, "left").withColumn("masked_share", share).withColumn("rejected", F.col("masked_share") >= most).drop("_cov")


def position_mask(positions: DataFrame, intervals: DataFrame, key: str, at: str = "pos", name: str = "covered") -> DataFrame:
    """Positions with 1 where an interval of the key covers them, else 0."""
    spans = islands(intervals, key).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    edges = spans.select(key, F.col("start").alias("_x"), F.lit(1).alias("_d"), F.lit(None).cast("boolean").alias("_p")).unionByName(
        spans.select(key, F.col("end").alias("_x"), F.lit(-1).alias("_d"), F.lit(None).cast("boolean").alias("_p")))
    every = positions.select(key, F.col(at).alias("_x"), F.lit(0).alias("_d"), F.lit(True).alias("_p")).unionByName(edges)
    depth = F.sum("_d").over(Window.partitionBy(key).orderBy("_x").rangeBetween(Window.unboundedPreceding, 0))
    return every.withColumn(name, (depth > 0).cast("int")).filter("_p").select(key, F.col("_x").alias(at), name)


def coverage_mean(tracks: DataFrame, key: str, value: str, lengths: DataFrame | None = None, length: str = "length") -> DataFrame:
    """Mean per position of the windows (key, start, end, value) that cover it, as runs (key, start, end, n, mean).

    Runs between neighbouring edges stand for their positions, so nothing is exploded
    by length. With `lengths`, uncovered stretches are runs of mean 0.
    """
    up = tracks.select(key, F.col("start").alias("x"), F.lit(1).alias("dn"), F.col(value).alias("dv"))
    down = tracks.select(key, F.col("end").alias("x"), F.lit(-1).alias("dn"), (-F.col(value)).alias("dv"))
    edges = up.unionByName(down)
    if lengths is not None:
        zero = F.lit(0)
        for x in (zero, F.col(length)):
            edges = edges.unionByName(lengths.select(key, x.cast("long").alias("x"), zero.alias("dn"), F.lit(0.0).alias("dv")))
    steps = edges.groupBy(key, "x").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    order = Window.partitionBy(key).orderBy("x")
    runs = steps.select(key, F.col("x").alias("start"), F.lead("x").over(order).alias("end"), F.sum("dn").over(order).alias("n"), F.sum("dv").over(order).alias("total"))
    runs = runs.filter(F.col("end").isNotNull())
    if lengths is None:
        runs = runs.filter("n > 0")
    return runs.select(key, "start", "end", "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("mean"))


def gaps_between(df: DataFrame, key: str, least: int = 20, leading: int = 50) -> DataFrame:
    """Stretches between consecutive intervals of a key longer than `least`, and one before the first longer than `leading`."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.lag("end").over(order)
    gap = df.select(key, F.coalesce(before, F.lit(0)).alias("gap_start"), F.col("start").alias("gap_end"), before.isNull().alias("_first"))
    size = F.col("gap_end") - F.col("gap_start")
    return gap.filter(F.when(F.col("_first"), size > leading).otherwise(size > least)).select(key, "gap_start", "gap_end", size.alias("size"))

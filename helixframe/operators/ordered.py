"""Ordered passes over whole tables without a single task: values are cut into ranges, ranges are summed, then each is scanned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a table, and the rows of the sample that they are taken from. Any ranges give the same results.
RANGES, SAMPLE = 64, 4096


def bounds(df: DataFrame, order: str, ranges: int = RANGES) -> list:
    """At most `ranges` - 1 values that part the rows about evenly, from a sample of bounded size."""
    n = df.count()
    share = min(1.0, SAMPLE / max(n, 1))
    some = [r[0] for r in df.select(order).filter(F.col(order).isNotNull()).sample(share, 7).orderBy(order).limit(4 * SAMPLE).collect()]
    return sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []


def range_number(order: str, at: list) -> Column:
    """How many bounds lie below a value; null counts as below all."""
    return F.size(F.filter(F.array(*(F.lit(b) for b in at)), lambda b: b < F.col(order))) if at else F.lit(0)


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (), descending: bool = False, before: bool = False, ranges: int = RANGES) -> DataFrame:
    """df with running sums of columns ({new name: column}) in the order of `order`, and their totals as `<new name>_total`.

    `before`: the sum of the rows before a row, without its own. Values of `order` are
    distinct within `by`. One table of ranges x groups rows carries the sums across.
    """
    part = range_number(order, bounds(df, order, ranges))
    keyed = df.withColumn("_range", -part if descending else part)
    starts = keyed.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))
    across = Window.partitionBy(*by, *(() if by else (F.lit(0),))).orderBy("_range")
    earlier, whole = across.rowsBetween(Window.unboundedPreceding, -1), across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.select(
        *(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_by_range"),
        *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums), *(F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in sums),
    )
    same = F.col("_range") == F.col("_by_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = keyed.join(starts, same)
    for n, c in sums.items():
        out = out.withColumn(n, F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_before_{n}"))
    return out.select(*df.columns, *(x for n in sums for x in (n, f"{n}_total")))


def class_ranks(df: DataFrame, label: str, order: Column, most: int, key: str, name: str, total: str | None = None, slices: int = RANGES) -> DataFrame:
    """df with the rank (from 1) of each row in its class, by `order`, a number from 0 to `most`, and the key; `total` adds the class's rows.

    A class is ranked in slices of the order side by side, whose counts (slices x
    classes rows) carry the ranks across.
    """
    rows = df.withColumn("_order", order).withColumn("_slice", F.floor(F.col("_order") / (most / slices)).cast("int"))
    across = Window.partitionBy("_label").orderBy("_by_slice")
    counts = rows.groupBy(F.col(label).alias("_label"), F.col("_slice").alias("_by_slice")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_label", "_by_slice", F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_label")).alias("_total"),
    )
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_order", key)))
    out = ranked.join(counts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_slice") == F.col("_by_slice")))
    return out.select(*df.columns, (F.col("_rank") + F.col("_before")).alias(name), *([F.col("_total").alias(total)] if total else []))

"""Connected components by alternating large-star and small-star steps, all of it joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _either(a: str, b: str, c: str, d: str, left: str = "u", right: str = "v") -> Column:
    """Two rows of each: (a, b) and (c, d)."""
    return F.inline(F.array(*(F.struct(F.col(x).alias(left), F.col(y).alias(right)) for x, y in ((a, b), (c, d)))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (u, v) of longs; the root is the smallest node that can be reached."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    seen = print_of(now)
    while seen[0]:
        both = now.select(_either("u", "v", "v", "u"))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = _least(large)  # u > v in every pair
        small = low.select(_either("v", "m", "u", "m")).filter("u <> v").distinct()
        now = cut(small)
        if (found := print_of(now)) == seen:
            break
        seen = found
    return now.select(_either("u", "v", "v", "v", "node", "root")).distinct()

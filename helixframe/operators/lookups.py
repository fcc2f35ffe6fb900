"""Joins and set operations on identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uncached(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """What still has to be computed."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def with_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def prefix_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str, least: int = 1) -> DataFrame:
    """Left rows with the right key that equals theirs, or else is a prefix of theirs or has theirs as prefix; the first by `order`.

    Prefixes join by equality: both sides are cut to the lengths that keys have, at
    most a few dozen, so no row meets all others. Keys under `least` letters, if it is
    raised, match whole only.
    """
    exact = left.join(right.select(F.col(right_key), F.col(order).alias("_o")), F.col(left_key) == F.col(right_key), "left")
    best = Window.partitionBy(left_key)
    hit = exact.filter(F.col(right_key).isNotNull()).withColumn("_m", F.min("_o").over(best)).filter("_o = _m").drop("_o", "_m").withColumn("match", F.lit("exact"))
    miss = left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_anti")
    cuts = lambda c: F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.length(c), F.lit(least))), lambda n: F.substring(c, F.lit(1), n)))
    a = miss.select(F.col(left_key).alias("_l")).distinct()
    b = right.select(F.col(right_key).alias("_r"), F.col(order).alias("_o"))
    down = a.withColumn("_p", cuts(F.col("_l"))).join(b.withColumn("_p", F.col("_r")), "_p")
    up = a.withColumn("_p", F.col("_l")).join(b.withColumn("_p", cuts(F.col("_r"))), "_p")
    first = down.unionByName(up).groupBy("_l").agg(F.min_by("_r", F.struct("_o", "_r")).alias("_r"))
    rest = miss.join(first, F.col(left_key) == F.col("_l"), "left").withColumnRenamed("_r", right_key).drop("_l")
    rest = rest.withColumn("match", F.when(F.col(right_key).isNotNull(), "prefix").otherwise("none"))
    return hit.unionByName(rest.select(*hit.columns))


def matched_vectors(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str, vector: str, size: int, share: float = 0.5) -> DataFrame | None:
    """(left_key, vector): of the key that prefix_join finds, zeros where it finds none; None if it finds one for less than `share` of the keys."""
    met = prefix_join(left.select(left_key).distinct(), right.select(right_key, order), left_key, right_key, order)
    n = met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("match") != "none").alias("met")).first()
    if n.n == 0 or n.met < share * n.n:
        return None
    own = right.groupBy(right_key).agg(F.min_by(vector, order).alias(vector))
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return met.join(own, right_key, "left").select(left_key, F.coalesce(F.col(vector).cast("array<float>"), zero).alias(vector))


def best_hit(hits: DataFrame, query: str, value: str | Column, tie: str) -> DataFrame:
    """The row of the smallest value of each query, the smaller tie on equality."""
    v = F.col(value) if isinstance(value, str) else value
    order = Window.partitionBy(query).orderBy(v, tie)
    return hits.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def tagged_union(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def set_overlap(universe: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: both, only_a, only_b, neither, by one aggregation of the keys."""
    keys = universe.select(key, F.lit(0).alias("w")).unionByName(a.select(key, F.lit(1).alias("w"))).unionByName(b.select(key, F.lit(2).alias("w")))
    by = keys.groupBy(key).agg(F.max((F.col("w") == 1).cast("int")).alias("a"), F.max((F.col("w") == 2).cast("int")).alias("b"))
    n = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    return by.agg(n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last one's values, in the first one's place."""
    rest = [c for c in df.columns if c not in (key, order)]
    by = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v"), F.min(order).alias(order))
    return by.select(order, key, *(F.col(f"_v.{c}").alias(c) for c in rest))


def renumber(df: DataFrame, cluster: str) -> DataFrame:
    """Cluster numbers without gaps from 0; -1 stays."""
    known = df.select(cluster).filter(F.col(cluster) >= 0).distinct()
    number = known.withColumn("_c", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(cluster)) - 1)
    return df.join(F.broadcast(number), cluster, "left").withColumn(cluster, F.coalesce("_c", F.lit(-1))).drop("_c")

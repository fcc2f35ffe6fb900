"""Deterministic sampling and splits: ranks of a hash of the key, so results depend on neither order nor partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import class_ranks

#: Fixed values of the arithmetic shuffle: factor and prime modulus.
FACTOR, PRIME = 2654435761, 4294967291


def key_order(key: str, seed: int = 42) -> Column:
    """An arithmetic shuffle of integer keys; other keys are hashed first."""
    number = F.coalesce(F.col(key).try_cast("long"), F.xxhash64(key))
    return F.pmod(F.pmod(number, F.lit(1 << 31)) * FACTOR + seed, F.lit(PRIME))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(key_order(key, seed), key).limit(n)


def stratified(df: DataFrame, stratum: str, total: int, key: str, seed: int = 42, strata: int | None = None) -> DataFrame:
    """About equal shares of each stratum (the first strata get what is left over), short strata filled up from the rest. total 0: all rows."""
    if total <= 0:
        return df
    ranked = class_ranks(df, stratum, key_order(key, seed), PRIME, key, "_r")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    numbered = sizes.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(stratum)) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    share = F.floor(F.lit(total) / F.col("_m")) + (F.col("_k") < F.pmod(F.lit(total), F.col("_m"))).cast("int")
    marked = ranked.join(F.broadcast(numbered.select(stratum, share.alias("_share"))), stratum)  # a row a stratum
    first = marked.filter(F.col("_r") <= F.col("_share"))
    got = numbered.agg(F.sum(F.least(F.col("_n"), share))).first()[0] or 0
    rest = marked.filter(F.col("_r") > F.col("_share")).orderBy(key_order(key, seed), key).limit(max(0, total - got))
    return first.unionByName(rest).drop("_r", "_share")


def balance(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class cut down to the smallest."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    ranked = class_ranks(df, label, key_order(key, seed), PRIME, key, "_r")
    return ranked.join(F.broadcast(least)).filter(F.col("_r") <= F.col("_least")).drop("_r", "_least")


def split(df: DataFrame, label: str, key: str, holdout: float = 0.2, seed: int = 42, name: str = "part") -> DataFrame:
    """`train`, `calibration` and `test` within each class; the latter two halve the holdout."""
    ranked = class_ranks(df, label, key_order(key, seed), PRIME, key, "_r", "_n")
    out = F.round(F.col("_n") * holdout).cast("int")
    part = F.when(F.col("_r") > out, "train").when(F.pmod("_r", F.lit(2)) == 1, "calibration").otherwise("test")
    return ranked.withColumn(name, part).drop("_r", "_n")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    ranked = class_ranks(df, label, key_order(key, seed), PRIME, key, "_r")
    return ranked.withColumn(name, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r")


#: Fragment lengths and how many of each a sequence gives.
FRAGMENTS = ((500, 3), (1000, 2), (2000, 2), (3000, 1), (5000, 1))


def fragments(df: DataFrame, key: str, sequence: str, seed: int = 42, table: tuple[tuple[int, int], ...] = FRAGMENTS, most_n: float = 0.05) -> DataFrame:
    """(key, size, copy, start, fragment): pieces at hashed starts; those with over `most_n` N are left out."""
    plan = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.lit(j).alias("copy")) for s, n in table for j in range(n))))
    rows = df.select(F.col(key), F.col(sequence).alias("_s"), plan.alias("p")).select(key, "_s", "p.*").filter(F.length("_s") >= F.col("size"))
    start = F.pmod(F.xxhash64(F.col(key), "size", "copy", F.lit(seed)), F.length("_s") - F.col("size") + 1)
    rows = rows.withColumn("start", start.cast("int")).withColumn("fragment", F.col("_s").substr(F.col("start") + 1, F.col("size")))
    unknown = F.length("fragment") - F.length(F.replace("fragment", F.lit("N"), F.lit("")))
    return rows.filter(unknown / F.col("size") <= most_n).drop("_s")

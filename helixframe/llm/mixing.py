"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the epoch divided by its
size. A document's number of copies is the Poisson quantile, at its source's rate, of
a number in (0, 1) hashed from its id and the seed, so the draw depends on neither the
partitioning nor the other rows. A rate above `PART_RATE` is cut into equal parts, whose
draws, each by a hash of its own, are added: a sum of Poisson numbers is one. Copies are
exploded and dealt out by a hash of id and copy, which shuffles all sources globally.

Nulls: a null source is a source of its own; a null id draws as one id does. Rows that
share an id draw the same count, each for itself; their copies tie in the shuffle. Texts
of any length are moved whole. An empty table gives no rows. All columns are returned;
names that are asked for and taken are an error. A source may have any rate; more than
`MAX_EPOCHS` are refused, whatever the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, unit_hash

#: Mean repetitions drawn by one number; exp(-rate) stays a normal number.
PART_RATE = 200.0
#: Most epochs that may be asked for.
MAX_EPOCHS = 200.0
#: Up to so many sources their rates are broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... far enough that what is left is below the resolution of the hash."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["all"], acc["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, more, lambda acc: acc["all"])


def source_rates(df: DataFrame, source: str, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, size: Column | None = None) -> DataFrame:
    """(source, rate, parts, cdf of a part). Targets are `weights`, or the sources' shares to the power `temperature`.

    The epoch is `epochs` times the whole input, in rows or in the sum of `size`. A
    source that `weights` doesn't name gets rate 0.
    """
    if epochs > MAX_EPOCHS:
        raise ValueError(f"the input is to be repeated over {MAX_EPOCHS} times")
    amount = F.sum(size if size is not None else F.lit(1)).cast("double")
    by = df.groupBy(F.col(source).alias("source")).agg(amount.alias("n"))
    if weights is None:
        by = by.withColumn("w", F.when(F.col("n") > 0, F.pow("n", F.lit(float(temperature)))).otherwise(0.0))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else None
        by = by.withColumn("w", F.coalesce(F.when(F.col("source").isNotNull(), given[F.col("source")]), F.lit(0.0)) if weights else F.lit(0.0))
    total = by.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))  # one row
    rate = F.when((F.col("n") > 0) & (F.col("all_w") > 0), F.lit(float(epochs)) * F.col("all_n") * F.col("w") / F.col("all_w") / F.col("n")).otherwise(0.0)
    rated = by.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))
    parted = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int"))
    return parted.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def mix_sources(df: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, size: Column | None = None, seed: int = 17, copy: str | None = None, rate: str | None = None, shuffle_key: str | None = None) -> DataFrame:
    """All columns of df, each row as often as drawn, in a global shuffle.

    The names `copy` (from 0), `rate` and `shuffle_key` add those columns.
    """
    taken = {c.lower() for c in df.columns}
    if clash := [x for x in (copy, rate, shuffle_key) if x and x.lower() in taken]:
        raise ValueError(f"there already are columns {', '.join(clash)}; name others")
    rates = source_rates(df, source, weights, temperature, epochs, size)
    s, r, p, c, k, o = (fresh(df, x) for x in ("_mix_source", "_mix_rate", "_mix_parts", "_mix_cdf", "_mix_copy", "_mix_order"))
    spark = df.sparkSession
    few = rates.limit(FEW_SOURCES + 1).collect()
    if len(few) <= FEW_SOURCES:
        rates = spark.createDataFrame(few, rates.schema).coalesce(1)
    rates = rates.select(F.col("source").alias(s), F.col("rate").alias(r), F.col("parts").alias(p), F.col("cdf").alias(c))
    rates = F.broadcast(rates) if len(few) <= FEW_SOURCES else rates
    below = lambda u: F.size(F.filter(F.col(c), lambda x: x < u))
    first = below(unit_hash(F.lit(seed), F.col(key)))
    others = F.aggregate(F.sequence(F.lit(1), F.col(p) - 1), F.lit(0), lambda n, part: n + below(unit_hash(F.lit(seed), F.col(key), part)))
    count = F.when(F.col(p) > 1, first + others).otherwise(first)
    drawn = (
        df.join(rates, F.col(source).eqNullSafe(F.col(s)), "inner")
        .withColumn(k, F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
        .withColumn(o, unit_hash(F.lit(seed + 1), F.col(key), F.col(k)))
    )
    mixed = drawn.repartition(F.col(o)).sortWithinPartitions(o)
    named = [F.col(a).alias(b) for a, b in ((k, copy), (r, rate), (o, shuffle_key)) if b]
    return mixed.select(*(F.col(f"`{x}`") for x in df.columns), *named)

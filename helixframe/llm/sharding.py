"""Weighted rendezvous sharding of stable record keys.

Every record scores each shard by ``-weight / ln(u)``, where u is a number in (0, 1)
hashed from the key and the shard's number, and goes to the best. A shard more can
only win records for itself, so a growth from n to n + 1 shards moves about one in
n + 1 records and none between old shards. All of it is built-in expressions.

Nulls: a null key is one key like any other, so all its rows share a shard. A null
text has size 8 and the checksum of no bytes, 0. Very long texts are measured whole.
Repeated rows share a shard and get slots of their own. Of shards with equal scores the
smaller number wins. An empty table gives no rows. Other columns are not read;
`with_slots` returns them, and its own column names give way to theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Parts of a shard that are numbered side by side; shards x parts rows are broadcast.
SLOT_PARTS = 256


def _bid(key: Column, shard: int, weight: float) -> Column:
    if not weight > 0:
        raise ValueError("weights are positive")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 12).cast("double")
    u = (bits + 0.5) / float(1 << 52)
    # greatest() compares by score, then takes the smaller shard
    return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("neg"))


def shard_of(key: str | Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) that wins the key. Append a weight to grow by a shard."""
    key = F.col(key) if isinstance(key, str) else key
    bids = [_bid(key, i, w) for i, w in enumerate(weights)]
    best = bids[0] if len(bids) == 1 else F.greatest(*bids)
    return (-best["neg"]).cast("int")


def with_slots(df: DataFrame, shard: str, order: str, slot: str = "slot", parts: int = SLOT_PARTS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is numbered in `parts` hash parts at once: each part starts where the
    counts of the parts before it end. The table of starts has at most
    shards x parts rows, whatever the input, and so is broadcast. Rows of one key, or
    of none, are spread over parts by all their columns' hash.
    """
    p, n, start, s, rank = (fresh(df, x) for x in ("_part", "_n", "_start", "_shard", "_rank"))
    whole = F.xxhash64(F.lit("slot"), *(F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType | T.VariantType)))
    keyed = df.withColumn(p, F.pmod(whole, F.lit(parts)).cast("int"))
    before = Window.partitionBy(s).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(F.col(shard).alias(s), p).agg(F.count(F.lit(1)).alias(n))
        .select(s, F.col(p).alias(n), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    )
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(shard, p).orderBy(order)).cast("long") - 1)
    numbered = ranked.join(F.broadcast(starts), F.col(shard).eqNullSafe(F.col(s)) & (F.col(p) == F.col(n)))
    return numbered.withColumn(slot, (F.col(start) + F.col(rank)).cast("long")).drop(p, n, start, s, rank)


def shard_documents(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """One row per document: its shard, its place there, and its shard after one more is added (law `key`)."""
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("one weight for each shard is needed")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, new_weight]).alias("grown_shard"),
    )
    return with_slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int = 24, key: str = "doc_id", weights: Sequence[float] | None = None, max_records_per_file: int = 5_000_000, column: str = "shard", tasks: int = 16) -> None:
    """Write whole rows as Parquet, a folder for each shard, by `tasks` tasks a shard; existing columns named `column` are not allowed."""
    if column.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there already is a column {column}; name another")
    out = df.withColumn(column, shard_of(key, list(weights or [1.0] * shards)))
    (out.repartition(column, F.pmod(F.xxhash64(F.col(key)), F.lit(tasks)))
     .write.option("maxRecordsPerFile", max_records_per_file).partitionBy(column).parquet(path))

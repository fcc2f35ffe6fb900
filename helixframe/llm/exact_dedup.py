"""Exact deduplication by 128-bit content hash, with bytes compared inside groups.

Hashes alone are grouped first, which moves 16 bytes a document. Only texts whose hash
repeats are grouped again, by hash and by the text itself: that comparison of bytes
parts texts that a hash collision would join. The verified groups then meet the
documents by hash and SHA-256.

Null text counts as empty. Rows that share both id and text are the same document
repeated: all carry the group's result; `drop_copies` leaves one of them. A null id
ranks below all others. Very long texts are hashed and compared whole. An empty table
gives no rows. Other columns are not read, but `drop_copies` returns them, and its own
column names give way to theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small_side


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def repeated_groups(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """(h, sha, keep_id, n) of every text that occurs more than once. keep: `min` or `max` id stays."""
    best = {"min": F.min, "max": F.max}[keep]
    src = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", digest(F.col("t")))
    again = cut(src.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    suspects = src.join(small_side(again, again.count(), 48), "h")
    same = suspects.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))  # compares the bytes
    return cut(same.filter("n > 1").select("h", _sha(F.col("t")).alias("sha"), "keep_id", "n"))


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = repeated_groups(df, key, text, keep, digest)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("doc_id"), digest(body).alias("h"), _sha(body).alias("sha"))
    groups = small_side(groups, groups.count(), 120)
    return docs.join(groups, ["h", "sha"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of df, with all their columns, less all copies of a text but one."""
    groups = repeated_groups(df, key, text, keep)
    names = [fresh(df, f"_dup_{x}") for x in ("h", "sha", "keep", "n")]
    h, sha, best, n = names
    groups = groups.toDF(h, sha, best, n)
    body = F.coalesce(F.col(text), F.lit(""))
    marked = df.withColumn(h, md5_128(body)).withColumn(sha, _sha(body))
    joined = marked.join(small_side(groups, groups.count(), 120), [h, sha], "left")
    alone = joined.filter(F.col(n).isNull())
    first = joined.filter(F.col(n).isNotNull() & F.col(key).eqNullSafe(F.col(best))).dropDuplicates([h, sha])  # of the kept rows alone
    return alone.unionByName(first).select(*(F.col(f"`{c}`") for c in df.columns))

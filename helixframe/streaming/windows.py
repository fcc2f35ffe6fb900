"""Windows over event time and incremental ingestion, the same code for batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def hopping(events: DataFrame, size: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, window_start in seconds, n, total) of overlapping windows."""
    by = _marked(events, late).groupBy("user_id", F.window("ts", size, step).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.unix_timestamp("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start in seconds, n, total): events less than the gap apart are one session, the streaming form of merging windows."""
    by = _marked(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.unix_timestamp("w.start").alias("session_start"), "n", "total")


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new keys, transformed, to a Parquet table; a restart resumes where it stopped.

    A batch that was written before its checkpoint was is not written twice: it goes to
    a folder of its own, which a retry replaces.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            seen = spark.read.parquet(path).filter(F.col("batch") < number).select(key)
            rows = rows.join(seen, key, "left_anti")
        except Exception as e:  # there is no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        transform(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

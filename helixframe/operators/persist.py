"""Checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a single-machine session makes one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for loops: a checkpoint keeps the planner's estimate of its size, which a join multiplies in every turn; a table has the size of its files."""
    path = f"{shared_folder(df.sparkSession)}/turn-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

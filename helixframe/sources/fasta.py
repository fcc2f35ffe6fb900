"""FASTA sources: a file is split where a line begins with the record mark, so large files are read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import last_wins


def read_fasta(spark: SparkSession, path: str, unique: bool = True, upper: bool = True) -> DataFrame:
    """(seq_ord, sequence_id, description, sequence).

    The id is the header's first word. Of records with one id the last sequence stands
    in the first one's place; `unique=False` keeps them all. Letters become capitals.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim("value") != "")
    header = F.regexp_replace(F.substring_index("value", "\n", 1), r"^\s+|\s+$", "")
    body = F.regexp_replace(F.substring("value", F.locate("\n", F.concat("value", F.lit("\n"))) + 1, F.length("value")), r"\s", "")
    letters = F.translate(body, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if upper else body
    rows = records.select(F.monotonically_increasing_id().alias("seq_ord"), F.element_at(F.split(header, r"\s+"), 1).alias("sequence_id"), header.alias("description"), letters.alias("sequence"))
    return last_wins(rows, "sequence_id", "seq_ord").select("seq_ord", "sequence_id", "description", "sequence") if unique else rows


def read_genomes(spark: SparkSession, path: str, prefix: str = "NC_", alphabet: str = "ACGTN") -> DataFrame:
    """Records whose id has the prefix, as DNA, that hold no other letters."""
    rows = read_fasta(spark, path).filter(F.col("sequence_id").startswith(prefix))
    return rows.withColumn("sequence", F.translate("sequence", "U", "T")).filter(F.col("sequence").rlike(f"^[{alphabet}]+$"))


def alignment_shape(spark: SparkSession, path: str) -> DataFrame:
    """One row: records and the length of the first."""
    rows = read_fasta(spark, path, unique=False)
    return rows.agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.min_by(F.length("sequence"), "seq_ord"), F.lit(0)).alias("alignment_length"))

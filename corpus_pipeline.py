"""The corpus pipeline: documents in known languages, without copies or near copies, mixed and packed.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and handles nulls,
empty and very long texts, repeated rows, empty tables and further columns as its
operator's docstring says. The last stage returns the packed pieces, the others rows
with the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import ensure_checkpoint_dir, remove, table
from helixframe.llm.exact_dedup import drop_copies
from helixframe.llm.language_id import keep_identified
from helixframe.llm.mixing import mix_sources
from helixframe.llm.packing import pack_documents
from helixframe.llm.simhash_similar import drop_similar


#: What the corpus is to hold.
LANGUAGES = ("de", "en", "es", "fr")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that are predicted, with a score of 0.4 or more, to be in one of LANGUAGES."""
    return keep_identified(docs, languages=LANGUAGES, min_score=0.4)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return drop_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more in five-word shingles, the row with the smallest doc_id stays."""
    return drop_similar(docs, shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their shares, in an epoch as large as the input: rows are left out or repeated as drawn."""
    return mix_sources(docs, temperature=0.5, epochs=1.0, seed=17)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return pack_documents(docs, capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The language and the tokenizer are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two the rows are written to the shared checkpoint folder and read again.

    What a stage wrote is deleted once the next one has written its own; the last written rows stay, as the result is read from them.
    """
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
            if i:
                remove(spark, f"{base}/{STAGES[i - 1][0]}")
    return docs

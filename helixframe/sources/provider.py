"""Vectors of sequences from a pluggable provider, kept in a resumable cache.

A provider turns a batch of sequences into vectors. It runs on the executors, a batch
at a time; a sequence it fails on is left out, and only if all fail is that an error.
The cache is a Parquet table partitioned by model and layer: what it has isn't
computed again, each batch is appended as it is done, and compaction rewrites a
partition into fewer files.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..operators.lookups import uncached

SCHEMA = "sequence_id string, embedding array<float>"

#: Bytes of a compacted file.
FILE_BYTES = 256 << 20


class Provider(ABC):
    """What a source of vectors has to offer. Objects are sent to the executors."""

    #: `alphabet`: letters that a sequence may have; None: any.
    name, max_length, alphabet = "", 16_000, None

    @abstractmethod
    def vectors(self, ids: list[str], sequences: list[str], layer: str) -> list[np.ndarray | None]:
        """A vector, or None for a failure, for each sequence."""

    def positions(self, ids: list[str], sequences: list[str], layer: str) -> list[np.ndarray | None]:
        """A matrix of a row for each position, if the provider can."""
        raise NotImplementedError(f"{self.name or type(self).__name__} has no vectors by position")

    def available(self) -> bool:
        return True


class HashProvider(Provider):
    """Vectors that depend on the sequence alone, for tests and dry runs."""

    name = "hash"

    def __init__(self, size: int = 64):
        self.size = size

    def _draw(self, text: str, shape: tuple[int, ...]) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
        return np.random.default_rng(seed).normal(size=shape).astype(np.float32)

    def vectors(self, ids: list[str], sequences: list[str], layer: str) -> list[np.ndarray | None]:
        return [self._draw(layer + s, (self.size,)) for s in sequences]

    def positions(self, ids: list[str], sequences: list[str], layer: str) -> list[np.ndarray | None]:
        return [self._draw(layer + s, (len(s), self.size)) for s in sequences]


class KmerProvider(Provider):
    """The 84 k-mer features as a vector."""

    name = "kmer"

    def vectors(self, ids: list[str], sequences: list[str], layer: str) -> list[np.ndarray | None]:
        from ..operators.kmers import features

        return [features(s) for s in sequences]


class LocalProvider(Provider):
    """A model on the machine itself: not part of this library."""

    name = "local"

    def vectors(self, ids: list[str], sequences: list[str], layer: str) -> list[np.ndarray | None]:
        raise NotImplementedError("no local model is included; register a provider that wraps yours")

    def available(self) -> bool:
        return False


_PROVIDERS: dict[str, type[Provider]] = {"hash": HashProvider, "kmer": KmerProvider, "local": LocalProvider}


def register(name: str, kind: type[Provider]) -> None:
    _PROVIDERS[name] = kind


def provider(name: str, **options) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider {name}; there are {', '.join(sorted(_PROVIDERS))}")
    return _PROVIDERS[name](**options)


def embed(df: DataFrame, source: Provider, layer: str, batch: int = 64) -> DataFrame:
    """(sequence_id, embedding) of sequences (sequence_id, sequence). Rows are sorted by length in a partition, so batches are even.

    A sequence that is empty, longer than the provider takes or has letters that it doesn't know is an error.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tried = failed = 0
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                got = source.vectors(part["sequence_id"].tolist(), part["sequence"].tolist(), layer)
                rows = [(i, v.astype(np.float32).tolist()) for i, v in zip(part["sequence_id"], got, strict=True) if v is not None]
                tried, failed = tried + len(part), failed + len(part) - len(rows)
                yield pd.DataFrame(rows, columns=["sequence_id", "embedding"])
        if tried and tried == failed:
            raise RuntimeError(f"all {tried} sequences of a partition failed")

    rows = df.select("sequence_id", seq.checked("sequence", "sequence_id", source.max_length, source.alphabet).alias("sequence"))
    return rows.sortWithinPartitions(F.length("sequence")).mapInPandas(each, SCHEMA)


def embed_positions(df: DataFrame, source: Provider, layer: str) -> DataFrame:
    """(sequence_id, pos, v): a row for each position."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i, s in zip(pdf["sequence_id"], pdf["sequence"], strict=True):
                m = source.positions([i], [s], layer)[0]
                if m is not None:
                    for at in range(0, len(m), 4096):
                        part = m[at : at + 4096]
                        yield pd.DataFrame({"sequence_id": i, "pos": np.arange(at, at + len(part)), "v": list(part.tolist())})

    return df.select("sequence_id", "sequence").mapInPandas(each, "sequence_id string, pos long, v array<float>")


def write_positions(df: DataFrame, source: Provider, layer: str, path: str) -> int:
    """Append vectors by position of the sequences that a folder lacks, and return how many those are. A sequence's rows are written whole."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema("sequence_id string").parquet(path).distinct() if there else spark.createDataFrame([], "sequence_id string")
    before = known.count()
    missing = uncached(df.select("sequence_id", "sequence"), known, "sequence_id")
    embed_positions(missing, source, layer).write.mode("append").parquet(path)
    return spark.read.schema("sequence_id string").parquet(path).distinct().count() - before


class Cache:
    """Vectors under a folder, by model and layer."""

    def __init__(self, spark: SparkSession, path: str, model: str, layer: str):
        self.spark, self.path, self.model, self.layer = spark, path, model.replace("-", "_"), layer.replace(".", "_")

    @property
    def folder(self) -> str:
        return f"{self.path}/model={self.model}/layer={self.layer}"

    def _exists(self) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        return p.getFileSystem(conf).exists(p)

    def read(self) -> DataFrame:
        """(sequence_id, embedding): of an id's several rows the last written."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(f"{SCHEMA}, written timestamp, ordinal long").parquet(self.folder)
        return rows.groupBy("sequence_id").agg(F.max_by("embedding", F.struct("written", "ordinal")).alias("embedding"))

    def ids(self) -> DataFrame:
        return self.read().select("sequence_id") if not self._exists() else self.spark.read.schema("sequence_id string").parquet(self.folder).distinct()

    def fill(self, df: DataFrame, source: Provider, layer: str, parts: int = 1) -> int:
        """Compute what is missing, in so many appends, and return how many rows that were. A stopped run keeps the appends it made."""
        missing = uncached(df.select("sequence_id", "sequence"), self.ids(), "sequence_id")
        before = self.ids().count()
        for i in range(parts):
            part = missing.filter(F.pmod(F.xxhash64("sequence_id"), F.lit(parts)) == i) if parts > 1 else missing
            self._stamped(embed(part, source, layer)).write.mode("append").parquet(self.folder)
        return self.ids().count() - before

    @staticmethod
    def _stamped(rows: DataFrame) -> DataFrame:
        return rows.withColumn("written", F.current_timestamp()).withColumn("ordinal", F.monotonically_increasing_id())  # of one append, the later row

    def append(self, rows: DataFrame) -> None:
        """Add rows (sequence_id, embedding), which stand before earlier ones of their ids."""
        self._stamped(rows.select("sequence_id", "embedding")).write.mode("append").parquet(self.folder)

    def gather(self, wanted: DataFrame, strict: bool = False, order: str | None = None) -> DataFrame:
        """wanted (sequence_id, ...) with embeddings, in the order of a column if it is named; ids without one are left out, or are an error."""
        out = wanted.join(self.read(), "sequence_id", "left" if strict else "inner")
        if strict:
            out = out.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no vector of "), "sequence_id"))).otherwise(F.col("embedding")))
        return out.orderBy(order) if order else out

    def compact(self, files: int | None = None, each: int = FILE_BYTES) -> None:
        """Rewrite the partition beside itself, move the old one aside, put the new one in its place, then delete the old one.

        files: how many; else as many as make about `each` bytes a file, written side by side.
        """
        new = f"{self.path}/_compacting_{self.model}_{self.layer}"
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        old, fresh = jvm.org.apache.hadoop.fs.Path(self.folder), jvm.org.apache.hadoop.fs.Path(new)
        fs = old.getFileSystem(conf)
        files = files or max(1, -(-fs.getContentSummary(old).getLength() // each))
        self._stamped(self.read()).repartition(files).write.mode("overwrite").parquet(new)
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_replaced_{self.model}_{self.layer}")
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"can't move {self.folder} aside")
        if not fs.rename(fresh, old):
            fs.rename(aside, old)
            raise OSError(f"can't move the compacted rows to {self.folder}")
        fs.delete(aside, True)


def check_size(df: DataFrame, size: int) -> None:
    """An error if a vector has another length than the model's."""
    other = df.filter(F.size("embedding") != size).select(F.size("embedding").alias("n")).limit(1).collect()
    if other:
        raise ValueError(f"vectors have {other[0].n} components, the model has {size}")

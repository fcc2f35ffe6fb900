"""MinHash near-deduplication: minima of universal hashes, banding, verified signatures and sets, components.

A document's set holds the 64-bit hashes of its distinct word shingles. Each of
BANDS x ROWS universal hash functions a*x + b (modulo 2**32, a odd) has a minimum over
the set; two sets agree in a minimum with the probability of their Jaccard similarity.
The lowest bytes of the ROWS minima of a band are the band's key. Sets with an equal key
meet, their signatures (all bytes) are compared, and a link is confirmed on the full sets.
A pair at exactly 0.85 is missed with a probability of some 4 in a million, by the bands
or the signature, a pair above it more seldom.

Documents with equal sets are one node, so copies make no pairs. What meets is linked by a
star in each bucket and then by comparing what is still apart (see `near`).

Null texts and texts without words have an empty set and link to nothing. Texts of fewer
words than a shingle are one shingle. Very long texts are read whole. Repeated rows
and rows that share an id are documents each, with the result of their own text. A null
id is no component's smallest, unless all are null. Ids of any type that can be ordered
will do. An empty table gives no rows. Other columns are not read, but
`drop_near_sets` returns them, and its own column names give way to theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, slices, small_side
from .near import CELL, Pairs, classes, company, confirmed, digest, linked, matrix, others_of, paired, shingle_hashes

#: Bands of a signature, and minima of a band: one byte each, so that a band's key is one long.
BANDS, ROWS = 48, 8
MINIMA = BANDS * ROWS
#: Standard deviations below the expected agreement at which a signature is still near enough.
SLACK = 4.5
_DRAWN = np.random.default_rng(20240607).integers(0, 1 << 32, (2, MINIMA), dtype=np.uint64).astype(np.uint32)
A, B = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The lowest byte of every minimum, eight to a long."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (A[:, None] * x[None, at : at + 2048] + B[:, None]).min(1))
    return least.astype(np.uint8).view(np.int64)


def set_prints(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """doc_id, n (size of the set), h (its digest) and sig of every row; h and sig are null for an empty set."""
    src = df.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    schema = T.StructType([src.schema["doc_id"], *T._parse_datatype_string("n long, h binary, sig array<long>")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, prints = [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), shingle)
                sizes.append(len(hashes))
                digests.append(digest(hashes) if len(hashes) else None)
                prints.append(signature(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "n", "h", "sig"])

    return src.mapInArrow(each, schema)


def least_agreement(percent: int) -> int:
    """Equal bytes of a signature below which a similarity of `percent` is out of the question."""
    p = percent / 100
    return int(MINIMA * p - SLACK * (MINIMA * p * (1 - p)) ** 0.5)


def _equal_bytes(a: Column, b: Column) -> Column:
    def equal(x: Column, y: Column) -> Column:  # the bits of every byte of the difference are gathered in its lowest
        d = x.bitwiseXOR(y)
        for by in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, by))
        return F.lit(8) - F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    return F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, n: s + n)


def verified(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The pairs (u, v) of nodes whose signatures agree in `least` bytes or more."""
    ends = lambda side: sigs.select(F.col("node").alias(side), F.col("sig").alias(f"s{side}"))
    return pairs.join(ends("u"), "u").join(ends("v"), "v").filter(_equal_bytes(F.col("su"), F.col("sv")) >= least).select("u", "v")


def cell_pairs(run: pa.Table, least: int) -> Pairs:
    """The pairs of one cell: of different components, that share a band and agree in `least` bytes."""
    sig = matrix(run, "sig", BANDS)
    octets = np.ascontiguousarray(sig).view(np.uint8)
    found = []
    for a, others in others_of(run):
        others = others[(sig[others] == sig[a]).any(1)]
        others = others[(octets[others] == octets[a]).sum(1) >= least]
        if len(others):
            found.append((a, others))
    return paired(run, found)


def near_sets(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 85, cell: int = CELL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is that)."""
    prints = cut(set_prints(df, key, text, shingle))
    nodes = prints.filter("h is not null").groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    sigs, least = nodes.select("node", "sig"), least_agreement(percent)
    met = company(nodes.select("node", F.posexplode("sig").alias("band", "k")), ["band", "k"])
    joined = linked(
        met, ["band", "k"], lambda pairs: verified(pairs, sigs, least), lambda pairs: confirmed(pairs, nodes, df, key, text, shingle, percent),
        sigs, lambda run: cell_pairs(run, least), cell,
    )
    groups, n = classes(nodes, joined)
    rows = prints.select("doc_id", "n", "h").join(small_side(groups, n, 48), "h", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_sets(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 85) -> DataFrame:
    """The rows of df, with all their columns, of each component's smallest id. An id with a row that stays, stays; rows without an id stay."""
    found = near_sets(df, key, text, shingle, percent)
    name = fresh(df, "_near_id")
    gone = cut(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias("k")).filter("not k").select(name))
    return df.join(small_side(gone, gone.count(), 16), F.col(key) == F.col(name), "left_anti")

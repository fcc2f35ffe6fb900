"""SimHash near-deduplication with multi-index hashing.

A fingerprint has 64 bits: a bit is 1 if more than half of the hashes of a text's word
shingles have it. Fingerprints link at 3 differing bits or fewer. Of two 32-bit halves
one then differs in a bit at most, so each fingerprint looks its halves up in a table
of all halves, as they are and with each 0 bit set in turn (the other end of such a
pair finds the 0 by its own look), and every match is verified on all 64 bits.

Equal fingerprints are one node, so copies make no pairs. A half that over `DENSE`
different fingerprints share makes its fingerprints dense; pairs of dense fingerprints
are linked instead by the values near them: within a distance of 3 lies a value at
most 1 from the one and at most 2 from the other. That is exact and in proportion to
the dense fingerprints (some two thousand rows each), not to their pairs: two dense ones
never meet in a table.

Null and empty texts have fingerprint 0, linked like any other. Repeated rows share
the fingerprint. Very long texts are read whole. A null id is no component's smallest,
unless all are null. An empty table gives no rows. Other columns are not read, but
`drop_near_copies` returns them, and its own column names give way to theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, small_side
from .components import components

LINK_BITS = 3
#: Different fingerprints that share a half before they are linked through near values.
DENSE = 1000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space of ASCII
    if not words:
        return 0
    runs = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(run, 42) for run in runs), np.uint64)
    # a byte for each bit, eight bytes to a word: up to 255 rows are added without a carry into the next byte
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    src = df.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("fp", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return src.mapInArrow(each, schema)


def _halves(nodes: DataFrame) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(0xFFFFFFFF).alias("v")) for s in (0, 1)))
    return nodes.select("*", F.inline(parts))


def near_edges(nodes: DataFrame, bits: int = LINK_BITS, dense: int = DENSE) -> DataFrame:
    """(u, v): edges that connect the different fingerprints `fp` of nodes exactly as all pairs at `bits` or fewer do."""
    if bits != 3:
        raise ValueError("two halves and balls of radius 1 find distances up to 3")
    halves = _halves(nodes.select("fp"))
    crowded = cut(halves.groupBy("s", "v").count().filter(F.col("count") > dense).select("s", "v"))
    n = crowded.count()
    if n:
        packed = cut(halves.join(small_side(crowded, n, 16), ["s", "v"]).select("fp").distinct())
        halves = halves.join(packed.withColumn("d", F.lit(True)), "fp", "left").withColumn("d", F.coalesce("d", F.lit(False)))
    else:
        halves = halves.withColumn("d", F.lit(False))
    flips = F.explode(F.array(*(F.lit(x).cast("long") for x in (0, *(1 << j for j in range(32))))))
    looks = halves.withColumn("flip", flips).filter(F.col("v").bitwiseAND(F.col("flip")) == 0)
    looks = looks.select("s", F.col("v").bitwiseOR(F.col("flip")).alias("v"), F.col("fp").alias("a"), "d", (F.col("flip") == 0).alias("same"))
    table = halves.select("s", "v", F.col("fp").alias("b"), "d")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = left.drop("d").join(right.drop("d"), ["s", "v"])
        pairs = pairs.filter((~F.col("same") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))

    if not n:
        return met(looks, table)
    # two dense ones never meet here, so a key holds no pairs of them; a dense one's equal half is looked up from the other side
    return met(looks, table.filter("not d")).unionByName(met(looks.filter("not d").withColumn("same", F.lit(False)), table.filter("d"))).unionByName(_through_near_values(packed))


def _through_near_values(nodes: DataFrame) -> DataFrame:
    """Stars around the values that a fingerprint lies within 1 of: at most 2081 different fingerprints lie within 2 of a value."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = [0, *(signed(1 << i) for i in range(64))]
    wide = [signed(1 << i | 1 << j) for i, j in combinations(range(64), 2)]
    masks = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(is_near).alias("near")) for group, is_near in ((near, True), (wide, False)) for m in group)))
    spread = nodes.withColumn("x", masks).select(F.col("fp").bitwiseXOR(F.col("x.m")).alias("z"), "fp", F.col("x.near").alias("near"))
    around = spread.groupBy("z").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("u"), F.collect_list("fp").alias("all"))
    return around.filter(F.col("u").isNotNull() & (F.size("all") > 1)).select("u", F.explode("all").alias("v")).filter("u <> v")


def near_components(prints: DataFrame, dense: int = DENSE) -> tuple[DataFrame, int]:
    """(fp, component_id) of the fingerprints that more than one row has or that have a link, and how many those are. prints: (doc_id, fp)."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = components(near_edges(nodes, dense=dense))
    known = nodes.join(linked, F.col("fp") == F.col("node"), "left").filter("root is not null or n > 1").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = cut(known)
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(least, "root").select("fp", "component_id"), known.count()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = cut(fingerprints(df, key, text, shingle))
    groups, n = near_components(prints, dense)
    joined = prints.join(small_side(groups, n, 32), "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of df, with all their columns, of each component's smallest id. Rows that share an id are one document; those without one stay."""
    found = near_duplicates(df, key, text, shingle)
    name = fresh(df, "_near_id")
    gone = cut(found.filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return df.join(small_side(gone, gone.count(), 16), F.col(key) == F.col(name), "left_anti")

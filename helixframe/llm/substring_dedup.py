"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of the last 32 bytes runs over each text. A chunk ends where it is the
smallest of `WINDOW` neighbouring ones, and starts, 32 to 36 bytes before, where the
gear hash of the last 4 bytes is the smallest: both ends follow the bytes alone, so an
insertion shifts chunks but doesn't change them, and texts that share `MIN_SPAN` bytes
or more always share a chunk in them. Chunks are grouped by digest. A chunk that came
before, in a smaller id, is laid beside that id's text, from `REACH` bytes before the
first common chunk to `REACH` after the last, and runs of `MIN_SPAN` equal bytes or more
are matches: that text holds all of it. Matches that overlap or touch are reported as one
span. A repeat is missed if each of its chunks has a smaller id that holds it but not
`MIN_SPAN` bytes around it.

Offsets count UTF-8 bytes and never halve a letter. Null and empty texts have no chunks.
A row without an id is neither reported nor kept as a source. Rows that share an id are
one document; if their texts differ, each text's spans are its own, and `drop_repeats`
cuts each row by its own. Repeats inside one document alone are left, unless `within` is
set: then a chunk's first place in its document is a source of the later ones. Of one
word over and over a chunk in each `WINDOW` bytes is kept, so that very long texts of
this kind cost no more than others. Of several sources the smallest id is taken. An
empty table gives no rows. Other columns are not read, but `drop_repeats` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes_np import run_hashes
from .common import cut, fresh, numbered

#: Bytes of a chunk, at least and at most, and how many bytes decide on it.
LEAST, MOST, DECIDE = 32, 36, 40
#: Neighbouring hashes of which the smallest ends a chunk: 62 + 40 - 1 = MIN_SPAN.
WINDOW = 62
#: Bytes compared beyond the outermost chunks; a longer match has one more chunk there.
REACH = WINDOW + DECIDE
#: Bytes of a reported span: 51 words of one letter.
MIN_SPAN = 101
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def _window(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The best of each n neighbours."""
    have = 1
    while have < n:
        by = min(have, n - have)
        x = best(x[:-by], x[by:])
        have += by
    return x


def gear(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The gear hashes, at each byte, of the last 4 bytes and of the last 32: each step shifts by a bit and adds a byte's number."""
    h = GEAR[np.frombuffer(text, np.uint8)]
    short = h
    for s in (1, 2, 4, 8, 16):  # doubles the bytes each time
        if len(h) > s:
            h = np.concatenate([h[:s], h[s:] + (h[:-s] << np.uint32(s))])
        if s == 2:
            short = h
    return short, h


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, starts and ends of a text's chunks."""
    n = len(text) - DECIDE + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    short, h = gear(text)
    # the shifts leave the latest byte's number in all bits, so equal hashes mean equal bytes but for chance
    h = h[DECIDE - 1 :]
    w = min(WINDOW, n)
    edge = np.zeros(w - 1, np.uint32)
    end = np.flatnonzero(_window(np.concatenate([edge, _window(h, w, np.minimum), edge]), w, np.maximum) == h) + DECIDE
    start = end - MOST + np.argmin(short[end[:, None] - MOST - 1 + np.arange(MOST - LEAST + 1)], axis=1)
    digest = run_hashes(np.frombuffer(text, np.uint8), [(start, end)])[0]
    digest = (digest ^ (digest >> np.uint64(29)) ^ (end - start).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    digest ^= digest >> np.uint64(32)
    # of a run of one chunk over and over, one in each window
    again = np.concatenate([[False], (digest[1:] == digest[:-1]) & (np.diff(end) < WINDOW)])
    since = (end - end[np.maximum.accumulate(np.where(again, 0, np.arange(len(end))))]) // WINDOW
    kept = ~again | (np.diff(since, prepend=0) > 0)
    return digest[kept].view(np.int64), start[kept], end[kept]


def chunked(texts: DataFrame, first: bool) -> DataFrame:
    """h, doc_id and start of the chunks of (doc_id, t); with `first` each once a row, and whether it comes again."""
    fields = ["h", "doc_id", "start", *(["again"] if first else [])]
    schema = T.StructType([T.StructField("h", T.LongType()), texts.schema["doc_id"], T.StructField("start", T.LongType()), *([T.StructField("again", T.BooleanType())] if first else [])])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes, starts, again = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for t in part.column(1):
                    h, start, _ = chunks(t.as_py())
                    if first:
                        h, place, n = np.unique(h, return_index=True, return_counts=True)
                        start = start[place]
                        again.append(n > 1)
                    hashes.append(h)
                    starts.append(start)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), [len(h) for h in hashes[1:]])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), ids, *(pa.array(np.concatenate(x)) for x in (starts, again)[: len(fields) - 2])], names=fields)

    return texts.mapInArrow(each, schema)


def equal_runs(a: bytes, b: bytes, least: int) -> list[tuple[int, int]]:
    """Where a and b, side by side, have `least` or more equal bytes in a row."""
    n = min(len(a), len(b))
    same = np.zeros(n + 2, np.int8)
    same[1:-1] = np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n)
    edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least].tolist()


def whole_letters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """start and end, moved inwards to where letters of UTF-8 begin and end."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    last = end - 1
    while last > start and text[last] & 0xC0 == 0x80:
        last -= 1
    if start < end:
        lead = text[last]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        end = end if last + size <= end else last
    return start, end


def matches(df: DataFrame, key: str, text: str, within: bool, least: int = MIN_SPAN) -> DataFrame:
    """doc_id, digest (of the row's text), start, end, first: runs of `least` bytes or more that `first`, the smallest id with one of their chunks, also holds."""
    texts = df.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("t")).filter((F.col("doc_id").isNotNull()) & (F.octet_length("t") >= DECIDE))
    held = chunked(texts, first=True).groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("start", "doc_id").alias("at"), F.max("again").alias("again"))
    shared = cut(held.filter((F.col("first") < F.col("last")) | (F.col("again") & F.lit(within))).select("h", "first", "at"))
    later = (F.col("doc_id") > F.col("first")) | (F.lit(within) & (F.col("doc_id") == F.col("first")) & (F.col("start") > F.col("at")))
    hits = chunked(texts, first=False).join(shared, "h").filter(later)  # a shuffle at every size; skewed hashes are split at run time
    chains = hits.groupBy("doc_id", "first", (F.col("start") - F.col("at")).alias("shift")).agg(F.min("start").alias("lo"), (F.max("start") + MOST).alias("hi"))
    chains = chains.withColumn("back", F.least(F.lit(REACH), "lo", F.col("lo") - F.col("shift")))
    chains = chains.withColumn("start", F.col("lo") - F.col("back")).withColumn("n", F.col("hi") - F.col("start") + REACH)
    piece = lambda side, at: F.substring(F.col(f"{side}.t"), (at + 1).cast("int"), F.col("n").cast("int"))
    theirs = chains.join(texts.alias("s"), F.col("first") == F.col("s.doc_id")).select(chains["doc_id"].alias("id"), "first", "start", "n", piece("s", F.col("start") - F.col("shift")).alias("theirs"))
    pairs = theirs.join(texts.alias("d"), F.col("id") == F.col("d.doc_id")).select("d.doc_id", F.xxhash64("d.t").alias("digest"), "first", "start", "theirs", piece("d", F.col("start")).alias("own"))
    kind = texts.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("digest", T.LongType()), T.StructField("first", kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (start, a, b) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True)):
                own = b.as_py()
                for x, y in equal_runs(a.as_py(), own, least):
                    x, y = whole_letters(own, x, y)
                    if y - x >= least:
                        rows.append(i)
                        starts.append(start + x)
                        ends.append(start + y)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 1, 2)), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[f.name for f in schema])

    return pairs.mapInArrow(each, schema)


def _spans(df: DataFrame, key: str, text: str, min_span: int, within: bool) -> DataFrame:
    found = matches(df, key, text, within, min_span)
    by = Window.partitionBy("doc_id", "digest").orderBy("start")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "digest", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("start", "end", "first").alias("n_chunks"), F.min_by("first", F.struct("start", "first")).alias("source_doc_id"), F.array_sort(F.collect_set("first")).alias("source_doc_ids"))
    return spans


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN, within: bool = False) -> DataFrame:
    """doc_id, start, end, n_chunks, source_doc_id, source_doc_ids of every repeated span: how many matches make it, the source of the first, and those of all, at most n_chunks."""
    return _spans(df, key, text, min_span, within).select("doc_id", "start", "end", "n_chunks", "source_doc_id", "source_doc_ids")


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """df with the repeated spans cut out of its texts; all else of a text stays as it is."""
    name, digest, spans = fresh(df, "_span_id"), fresh(df, "_span_digest"), fresh(df, "_spans")
    cuts = _spans(df, key, text, min_span, False).groupBy(F.col("doc_id").alias(name), F.col("digest").alias(digest)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    joined = df.join(cuts, (F.col(key) == F.col(name)) & (F.xxhash64(F.col(text).cast("binary")) == F.col(digest)), "left")
    names, at, schema = df.columns, df.columns.index(text), df.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if gone:
                    body, last, kept = t.encode(), 0, []
                    for g in gone:
                        start, end = whole_letters(body, *g.values())
                        kept.append(body[last:start])
                        last = end
                    t = b"".join([*kept, body[last:]]).decode()
                texts.append(t)
            columns = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return numbered(joined.select(*(F.col(f"`{c}`") for c in names), spans)).mapInArrow(each, schema)

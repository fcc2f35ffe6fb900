"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Pieces of one length are interchangeable, so the packing is planned on the histogram
of lengths, which has at most `capacity` rows whatever the input. Large-item matching:
lengths above a third of the capacity are matched greedily, the longest with the
longest that still fits, at most two to a sequence. Shorter pieces then go, the
longest first, to the tightest gap that holds them. Equal steps are taken for whole
ranges of sequences at once, so the plan has some ten thousand rows at most. It says
for every (length, rank) which sequence and offset it gets; the pieces are ranked in
parallel and look their places up.

Null text counts as empty, which still has the end id and so is a piece of length 1.
Repeated rows are packed each for itself; a null id sorts first. Very long texts are
encoded whole, in memory proportional to them. Pieces of equal length are alike to the
plan: their places go by a hash of id and piece, then by these. An empty table gives no
rows. Other columns are not read; `pack_pieces` returns them, and its own column names
give way to theirs.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, numbered, small_side

CAPACITY = 2048
#: Hash slices of the whole input in which ranks are counted, besides one for each length: so many, or of so many pieces.
SLICES, SLICE_PIECES = 1024, 1_000_000
#: Words of which a worker remembers the ids.
REMEMBERED = 600_000
#: Letters of the longest of them.
LONGEST = 64

#: The one special token of the vocabulary, and the places where splitting at single spaces would differ from the tokenizer's own pattern.
SPECIAL = "<|endoftext|>"
NOT_PLAIN = re.compile(r"\s\s|^\s|\s$|[^\S\n ]")


class WordIds(dict):
    """Ids, as little-endian 32-bit bytes, of a word and the space before it."""

    def __init__(self, vocabulary: str, pattern: str, whole: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole, self.tokenizer = whole, None

    def __missing__(self, word: str) -> bytes:
        ids = self.pack(self.encode(" " + word))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def text(self, text: str) -> bytes:
        """The ids of a whole text. Words between single spaces are encoded alone; texts with other white space, or with the special token, go through the tokenizer whole."""
        if SPECIAL in text:
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.whole)
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if NOT_PLAIN.search(text):
            return self.pack(self.encode(text))
        first, *rest = text.split(" ")
        return self.pack(self.encode(first)) + b"".join(map(self.__getitem__, rest))


_words: dict[tuple[str, str], WordIds] = {}


def _word_ids(vocabulary: str | None, tokenizer: str | None) -> WordIds:
    import public_tokenizers

    key = (vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    if key not in _words:
        _words[key] = WordIds(key[0], public_tokenizers.PATTERN, key[1])
    return _words[key]


def cuts(tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece; only the first is shorter than the capacity."""
    start, length = 0, tokens % capacity or capacity
    while start < tokens:
        yield start, length
        start, length = start + length, capacity


def tokenized_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and `ids`, the little-endian bytes) of every piece of every text."""
    src = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    fields = [T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    end = array("I", [end_id]).tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(vocabulary, tokenizer)
        for batch in batches:
            which, piece, starts, lengths, sums, kept = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = words.text(t.as_py()) + end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    which.append(i), piece.append(k), starts.append(start), lengths.append(length), sums.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = [f.name for f in schema]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_ids else []), names=names)

    return src.mapInArrow(split, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces to a sequence, first offset) by length and rank.

    Pieces of a length from the first rank to that of the next row go to consecutive
    sequences, so many to each, one behind the other from the offset.
    """
    left, rank = dict(counts), dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap, ranges (first sequence, sequences)
    order: list[int] = []  # the gaps that there are
    sequences = 0

    def opened(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not gaps.setdefault(gap, []):
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(length: int, first: int, bins: int, each: int, offset: int) -> None:
        rows.append((length, rank[length], first, each, offset))
        rank[length] += bins * each
        left[length] -= bins * each

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= a and a + b <= capacity and left[b] > (a == b)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, sequences, n, 2 if a == b else 1, 0)
            if b is not None and b != a:
                put(b, sequences, n, 1, a)
            opened(capacity - a - (b or 0), sequences, n)
            sequences += n

    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while n := left[s]:
            k = bisect_left(order, s)
            if k < len(order):
                gap = order[k]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del order[k]
            else:
                gap, first, bins = capacity, sequences, -(-n // (capacity // s))
                sequences += bins
            each = min(gap // s, n)
            used = min(bins, n // each)
            put(s, first, used, each, capacity - gap)
            opened(gap - each * s, first, used)
            opened(gap, first + used, bins - used)
    return sorted(rows)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `capacity` tokens. `pieces` is read several times."""
    spark = pieces.sparkSession
    histogram = {int(r[0]): r[1] for r in pieces.groupBy(length).count().collect()}  # one row a length
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("a piece is empty or longer than the capacity")
    rows = plan(histogram, capacity)
    total = sum(histogram.values())
    each = min(-(-total // SLICES), SLICE_PIECES) or 1
    size, many, part, n, earlier, rank = (fresh(pieces, x) for x in ("_len", "_slices", "_slice", "_n", "_before", "_rank"))
    slices = spark.createDataFrame([(s, -(-k // each)) for s, k in histogram.items()], f"{size} long, {many} long").coalesce(1)
    sliced = (
        pieces.join(F.broadcast(slices), F.col(length) == F.col(size))
        .withColumn(part, F.pmod(F.xxhash64(*order), F.col(many)))
        .drop(many)
    )
    before = Window.partitionBy(size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(size, part).agg(F.count(F.lit(1)).alias(n))  # at most capacity + total / each rows
        .select(size, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(earlier))
    )
    starts = small_side(starts, len(histogram) + total // each + 1, 40)
    in_slice = F.row_number().over(Window.partitionBy(size, part).orderBy(*order)) - 1
    ranked = sliced.withColumn(rank, in_slice).join(starts, [size, part]).withColumn(rank, F.col(earlier) + F.col(rank))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    shared = spark.sparkContext.broadcast(rows)
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = np.array(shared.value, np.int64).reshape(-1, 5)
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            tokens, number = (batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row = table[np.searchsorted(keys, (tokens << 44) + number, side="right") - 1]
            past = number - row[:, 1]
            found = [pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *found], names=[f.name for f in out])

    return numbered(ranked.select(*(F.col(f"`{c}`") for c in names), size, rank)).mapInArrow(place, out)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **tokens) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack_pieces(cut(tokenized_pieces(df, key, text, capacity, **tokens)), capacity)


def sequences(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **tokens) -> DataFrame:
    """sequence_id and ids (little-endian bytes): the packed sequences themselves, each at most `capacity` ids."""
    placed = pack_pieces(cut(tokenized_pieces(df, key, text, capacity, with_ids=True, **tokens)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    empty = F.lit(b"").cast("binary")
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, empty, lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))

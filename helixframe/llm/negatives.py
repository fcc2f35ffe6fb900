"""Hard-negative mining with an inverted multi-index.

An anchor's positives are its best rows of the same label, its hard negatives for one of
them the best rows of other labels whose score lies in a window below the positive's.
Scores are integer inner products of vectors times `scale`, rounded down.

The two halves of a vector have a codebook each; a row's cell is its pair of nearest
codewords. What a codeword's rows can add to a score is at most the codeword's own part
plus the half's length times the codeword's radius, the largest distance of its rows. A
heap over the two sorted lists of such bounds visits the cells of a block by falling sums
(multi-sequence). A search for positives stops when its last place is above the next sum.
A search for negatives has a window for each positive; cells whose least score lies above
all windows are passed over, a window is certified when its last place is above the next
sum or the sum falls below the window, and the search stops when all are certified. The
stop is strict, so ties are found, and results are exact whatever the codebooks are.

Codebooks are learned from at most `SAMPLE` rows. Anchors meet all rows in blocks of
bounded size, in which rows are put into cells; of a block, each anchor keeps its best
only. The work beyond pruning is anchors times rows. Nearly isotropic vectors leave loose
bounds: there most cells are visited.

Rows without an id (ids that are no whole numbers count as none), label or vector, and
vectors with null or non-finite components, take no part. Vectors of different lengths
don't meet. Of rows that share an id only the one of the smallest label, then vector,
takes part. Ties go to the smaller id. Zero vectors score 0. Scores have to fit 63 bits.
An anchor without positives, and a positive without negatives, give no rows, nor does an
empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, unit_hash

#: Rows that the codebooks are learned from, at most; codewords of a half.
SAMPLE, WORDS = 4096, 16
#: Components of a block of rows and of anchors; rows that are scored at once.
BLOCK, ANCHORS, STEP = 1 << 21, 1 << 18, 512

Books = dict[int, tuple[np.ndarray, np.ndarray]]


def codebook(x: np.ndarray, words: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Codewords of vectors, by Lloyd's iterations."""
    rng = np.random.default_rng(seed)
    book = x[rng.permutation(len(x))[:words]].astype(float)
    for _ in range(rounds):
        near = nearest_word(x, book)
        for k in range(len(book)):
            own = x[near == k]
            if len(own):
                book[k] = own.mean(0)
    return book


def nearest_word(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * (x @ book.T), axis=1)


def learn(vectors: list[np.ndarray], words: int = WORDS) -> Books:
    """Codebooks of both halves for every length of vectors that the sample has."""
    out: Books = {}
    for d in {len(v) for v in vectors}:
        x = np.stack([v for v in vectors if len(v) == d]).astype(float)
        h = d // 2
        out[d] = codebook(x[:, :h], words), codebook(x[:, h:], words)
    return out


class MultiIndex:
    """The cells of one block of rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: Books):
        d = x.shape[1]
        self.ids, self.labels, self.half = ids, labels, d // 2
        self.halves = x[:, : self.half].astype(float), x[:, self.half :].astype(float)
        self.books = books.get(d) or (np.zeros((1, self.half)), np.zeros((1, d - self.half)))
        word = [nearest_word(h, b) for h, b in zip(self.halves, self.books, strict=True)]
        far = [np.sqrt(((h - b[w]) ** 2).sum(1)) for h, b, w in zip(self.halves, self.books, word, strict=True)]
        self.radii = [np.full(len(b), -1.0) for b in self.books]
        for r, w, f in zip(self.radii, word, far, strict=True):
            np.maximum.at(r, w, f)
        cell = word[0] * len(self.books[1]) + word[1]
        self.order = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[self.order], np.arange(len(self.books[0]) * len(self.books[1]) + 1))
        self.x = x
        self.exact = np.hstack(self.halves)  # as doubles
        self.longest = float(np.sqrt((self.exact**2).sum(1).max(initial=0)))
        self.scored = self.visited = 0

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact: doubles hold whole numbers below 2**53, longs are slower."""
        self.scored += len(rows)
        if self.longest * float(np.sqrt((q.astype(float) ** 2).sum())) < 2**52:
            return (self.exact[rows] @ q.astype(float)).astype(np.int64)
        return (self.x[rows] * q).sum(1)

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, float, np.ndarray]]:
        """(most, least, rows) of the cells by falling bound; the bounds of their scores have room for rounding."""
        parts = q[: self.half].astype(float), q[self.half :].astype(float)
        middle = [b @ p for b, p in zip(self.books, parts, strict=True)]
        reach = [np.sqrt(p @ p) * r for p, r in zip(parts, self.radii, strict=True)]
        high = [np.where(r >= 0, m + w, -np.inf) for m, w, r in zip(middle, reach, self.radii, strict=True)]
        sort = [np.argsort(-h, kind="stable") for h in high]
        slack = 1 + 1e-9 * (abs(high[0][np.isfinite(high[0])]).max(initial=0) + abs(high[1][np.isfinite(high[1])]).max(initial=0))
        bound = lambda a, b: float(high[0][sort[0][a]] + high[1][sort[1][b]])
        heap = [(-bound(0, 0), 0, 0)]
        while heap:
            top, a, b = heapq.heappop(heap)
            if top == np.inf:
                return
            if b + 1 < len(sort[1]):
                heapq.heappush(heap, (-bound(a, b + 1), a, b + 1))
            if b == 0 and a + 1 < len(sort[0]):
                heapq.heappush(heap, (-bound(a + 1, 0), a + 1, 0))
            i, j = sort[0][a], sort[1][b]
            at = i * len(sort[1]) + j
            rows = self.order[self.starts[at] : self.starts[at + 1]]
            if len(rows):
                yield -top + slack, float(middle[0][i] - reach[0][i] + middle[1][j] - reach[1][j]) - slack, rows

    def batches(self, q: np.ndarray, above: float = np.inf) -> Iterator[tuple[float, np.ndarray]]:
        """(most of these and all later cells, rows), some cells at a time; without cells whose every score is over `above`."""
        held: list[np.ndarray] = []
        n, first = 0, 0.0
        for most, least, rows in self.cells(q):
            if least > above:
                continue
            if not held:
                first = most
            self.visited += 1
            held.append(rows)
            n += len(rows)
            if n >= STEP:
                yield first, np.concatenate(held)
                held, n = [], 0
        if held:
            yield first, np.concatenate(held)

    def positives(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those of the id `own`."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for most, rows in self.batches(q):
            if len(ids) == k and most < scores[-1]:
                break
            rows = rows[self.ids[rows] != own]
            ids, scores = _best(np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.scores(rows, q)]), k)
        return ids, scores

    def negatives(self, own: int, label: object, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score) the (ids, scores) of the k best rows of other labels in it."""
        none = np.zeros(0, np.int64)
        found = [(none, none) for _ in windows]
        open_ = {w for w, (lo, hi) in enumerate(windows) if lo <= hi}
        above = max((windows[w][1] for w in open_), default=0)
        for most, rows in self.batches(q, above) if open_ else ():
            open_ = {w for w in open_ if most >= windows[w][0] and not (len(found[w][0]) == k and most < found[w][1][-1])}
            if not open_:
                break
            rows = rows[(self.labels[rows] != label) & (self.ids[rows] != own)]
            s = self.scores(rows, q)
            for w in open_:
                lo, hi = windows[w]
                fits = (s >= lo) & (s <= hi)
                if fits.any():
                    found[w] = _best(np.concatenate([found[w][0], self.ids[rows[fits]]]), np.concatenate([found[w][1], s[fits]]), k)
        return found


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _one_each(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of rows that share an id, the one of the smallest label, then vector."""
    if pdf["id"].is_unique:
        return pdf
    again = pdf["id"].duplicated(keep=False)
    first = {}
    for at, (i, label, v) in pdf.loc[again, ["id", "label", "v"]].iterrows():
        own = (label, list(v), at)
        first[i] = min(first.get(i, own), own)
    return pd.concat([pdf[~again], pdf.loc[sorted(x[2] for x in first.values())]])


def whole_vectors(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, with their components scaled and rounded down."""
    src = df.select(F.col(key).try_cast("long").alias("id"), label.alias("label"), F.col(vector).cast("array<double>").alias("x")).filter("id is not null and label is not null and x is not null")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return src.filter(F.coalesce(fine, F.lit(False))).select("id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 50, positives: int = 5, negatives: int = 3,
    window: tuple[int, int] = (50, 95), scale: int = 256, sample: int = SAMPLE, block: int = BLOCK, anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (ids divisible by `every`) and each of its first `positives`
    rows of its label, the first `negatives` rows of other labels whose score lies within `window` per cent of the positive's."""
    spark = df.sparkSession
    rows = cut(whole_vectors(df, key, vector, F.col(label) if isinstance(label, str) else label, scale))
    ask = rows.filter(F.col("id") % every == 0)
    size = F.size("v").cast("long")
    n, total, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("id") % every == 0, size)), F.lit(0))).first()
    u = unit_hash(F.lit("sample"), F.col("id"))
    drawn = rows.withColumn("u", u).filter(F.col("u") <= min(1.0, (sample + 4 * sample**0.5) / max(n, 1)))
    picked = drawn.orderBy("u", "id").select("v").limit(sample).toPandas()  # bounded by `sample`
    books = spark.sparkContext.broadcast(learn(list(picked["v"])))

    c, b = -(-total // block) or 1, -(-asked // anchors) or 1
    part = lambda name, m: F.pmod(F.xxhash64(F.lit(name), F.col("id")), F.lit(m)).cast("int")
    each_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("c", part("c", c)).withColumn("b", each_of(b)).withColumn("d", F.size("v")).groupBy("d", "c", "b")
    blocks = lambda q: left.cogroup(q.withColumn("b", part("b", b)).withColumn("c", each_of(c)).withColumn("d", F.size("v")).groupBy("d", "c", "b"))
    kind = rows.schema["label"].dataType
    long_, int_ = T.LongType(), T.IntegerType()

    def of_label(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            x, q = _one_each(x), _one_each(q)
            for value, own in q.groupby("label"):
                same = x[x["label"] == value]
                if len(same):
                    index = MultiIndex(same["id"].to_numpy(), same["label"].to_numpy(), np.stack(same["v"]), books.value)
                    for i, v in zip(own["id"], own["v"], strict=True):
                        ids, scores = index.positives(i, v, positives)
                        out += [(i, value, v, p, s) for p, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["id", "label", "v", "p", "s"])

    first = blocks(ask).applyInPandas(of_label, T.StructType([T.StructField("id", long_), T.StructField("label", kind), T.StructField("v", T.ArrayType(long_)), T.StructField("p", long_), T.StructField("s", long_)]))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "p"))
    first = cut(first.withColumn("at", place).filter(F.col("at") <= positives).drop("at"))
    pairs = first.groupBy("id").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct("p", "s"))).alias("ps"))  # few a row
    low, high = window

    def others(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            x = _one_each(x)
            index = MultiIndex(x["id"].to_numpy(), x["label"].to_numpy(), np.stack(x["v"]), books.value)
            for i, value, v, ps in zip(q["id"], q["label"], q["v"], q["ps"], strict=True):
                windows = [(-(-low * p["s"] // 100), high * p["s"] // 100) for p in ps]  # whole numbers between, both ends included
                for p, (ids, scores) in zip(ps, index.negatives(i, value, v, windows, negatives), strict=True):
                    out += [(i, p["p"], m, p["s"], s) for m, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    met = blocks(pairs).applyInPandas(others, T.StructType([T.StructField(x, long_) for x in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")]))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")).cast(int_)
    ranked = met.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

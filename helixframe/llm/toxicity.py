"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the first four and five bytes of longer words, hashed. A
term gets a linear weight and a vector if the classes differ in it. So does each of two
terms of which one changes what the other says: for all pairs of the commonest terms,
that interaction is measured in the residuals of a first machine. The score adds the weights
of the terms present and the products of all pairs of their vectors, so two terms can
mean together what neither means alone.
Training: at most `PER_CLASS` labelled texts of each class, those whose ids hash lowest.
Scoring is one pass over the whole text, in work proportional to its length.

Scores use the text alone. Null and empty texts have no terms and get the score of
the constant alone. A document labelled twice counts as toxic if one label says so;
null labels and ids, and held-out rows, are not learned from. Without labelled texts
every score is 0. Repeated rows score alike; terms equally common are taken by hash. An
empty table gives no rows. Columns other than those named are not read, so their names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes_np import chunks, mixed, run_hashes, words
from .common import held_out, slices, unit_hash

#: Bound of the training sample: texts of each class.
PER_CLASS = 4000
BITS = 20
#: Terms with a weight, and components of a term's vector.
TERMS, FACTORS = 8192, 8
#: Standard deviations by which the classes differ in a term; of a million hashed terms chance alone lifts few above it.
MIN_STRENGTH = 4.0
#: Commonest terms of the sample whose pairs are measured, and standard deviations of an interaction; of eight million pairs chance lifts hardly one above it.
PAIRED, MIN_INTERACTION = 4096, 6.0


def term_hashes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hashed term) of every word and prefix, repeats included."""
    for first, buffer, ends in chunks([(t or "").lower().encode() for t in texts]):
        s, e = words(buffer)
        if not len(s):
            continue
        doc = np.searchsorted(ends, s, side="right") + first
        long4, long5 = e - s > 4, e - s > 5
        whole, four, five = run_hashes(buffer, [(s, e), (s[long4], s[long4] + 4), (s[long5], s[long5] + 5)])
        salt = np.uint64(0xD6E8FEB86659FD93)
        yield np.concatenate([doc, doc[long4], doc[long5]]), np.concatenate([mixed(whole, BITS), mixed(four ^ salt, BITS), mixed(five ^ (salt << np.uint64(1)), BITS)])


@dataclass
class Machine:
    number: np.ndarray  # of a hashed term, or -1
    constant: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic function; (doc, term) pairs are distinct."""
        linear = np.bincount(doc, self.weights[term], n)
        v = self.vectors[term]
        pairs = np.zeros(n)
        for f in range(v.shape[1]):
            pairs += np.bincount(doc, v[:, f], n) ** 2 - np.bincount(doc, v[:, f] ** 2, n)
        return self.constant + linear + pairs / 2

    def chance(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of rows of distinct hashed terms."""
        docs, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, r in enumerate(rows):
            known = self.number[r][self.number[r] >= 0]
            docs.append(np.full(len(known), i)), terms.append(known)
        return 1 / (1 + np.exp(-np.clip(self.raw(np.concatenate(docs), np.concatenate(terms), len(rows)), -40, 40)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        docs, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, h in term_hashes(texts):
            number = self.number[h]
            known = number >= 0
            both = np.unique(doc[known].astype(np.int64) << 32 | number[known])
            docs.append(both >> 32), terms.append(both & 0xFFFFFFFF)
        return 1 / (1 + np.exp(-np.clip(self.raw(np.concatenate(docs), np.concatenate(terms), len(texts)), -40, 40)))


def pair_strength(rows: list[np.ndarray], residual: np.ndarray, terms: np.ndarray, least: int = 20) -> np.ndarray:
    """Of each term, the most standard deviations by which another one changes the difference that it makes to the mean residual.

    Each of the four cells of two terms (both, either, none) has `least` texts or more.
    """
    at = np.full(1 << BITS, -1, np.int32)
    at[terms] = np.arange(len(terms))
    x = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        x[i, at[r][at[r] >= 0]] = 1
    e = residual.astype(np.float32)
    n, total, deviation = x.sum(0), e @ x, max(float(e.std()), 1e-9)
    best = np.zeros(len(terms))
    for lo in range(0, len(terms), 256):
        own = x[:, lo : lo + 256]
        both, sums = own.T @ x, (own * e[:, None]).T @ x
        a, sa = n[lo : lo + 256, None], total[lo : lo + 256, None]
        cells = [(both, sums, 1), (a - both, sa - sums, -1), (n - both, total - sums, -1), (len(e) - a - n + both, float(e.sum()) - sa - total + sums, 1)]
        contrast = sum(sign * s / np.maximum(k, 1) for k, s, sign in cells)
        spread = deviation * np.sqrt(sum(1 / np.maximum(k, 1) for k, _, _ in cells))
        full = np.minimum.reduce([k for k, _, _ in cells]) >= least
        best[lo : lo + 256] = np.where(full, np.abs(contrast) / spread, 0).max(1, initial=0)
    return best


def fit(rows: list[np.ndarray], y: np.ndarray, terms: int = TERMS, paired: int = PAIRED, **steps) -> Machine:
    """A machine of the terms that tell the classes apart, alone or in pairs. rows: distinct hashed terms."""
    n1, n0 = max(1, (y > 0).sum()), max(1, (y == 0).sum())
    in1 = np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, t in zip(rows, y, strict=True) if t)]), minlength=1 << BITS)
    in0 = np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, t in zip(rows, y, strict=True) if not t)]), minlength=1 << BITS)
    p1, p0, p = in1 / n1, in0 / n0, (in1 + in0) / (n1 + n0)
    spread = np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    strength = np.where((in1 + in0 >= 3) & (spread > 0), np.abs(p1 - p0) / np.maximum(spread, 1e-12), 0.0) / MIN_STRENGTH
    strongest = lambda: (best := np.argsort(-strength, kind="stable")[:terms])[strength[best] > 1]
    first = strongest()
    machine = descend(rows, y, first, **steps)
    common = np.argsort(-(in1 + in0), kind="stable")[:paired]
    common = common[(in1 + in0)[common] > 0]
    residual = (y - machine.chance(rows)) * np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))
    strength[common] = np.maximum(strength[common], pair_strength(rows, residual, common) / MIN_INTERACTION)
    both = strongest()
    return machine if len(both) == len(first) else descend(rows, y, both, **steps)


def descend(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, factors: int = FACTORS, epochs: int = 12, rate: float = 0.08, decay: float = 2e-4, seed: int = 11) -> Machine:
    """A machine of the terms by adaptive gradient steps on logistic loss, classes weighted alike."""
    n1, n0 = max(1, (y > 0).sum()), max(1, (y == 0).sum())
    number = np.full(1 << BITS, -1, np.int32)
    number[terms] = np.arange(len(terms))
    own = [number[r][number[r] >= 0] for r in rows]
    rng = np.random.default_rng(seed)
    w, v, c = np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), factors)), 0.0
    gw, gv, gc = np.full(len(terms), 1e-6), np.full((len(terms), factors), 1e-6), 1e-6
    cost = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            t = own[i]
            vt = v[t]
            total = vt.sum(0)
            raw = c + w[t].sum() + 0.5 * float((total**2 - (vt**2).sum(0)).sum())
            g = cost[i] * (1 / (1 + np.exp(-min(max(raw, -30.0), 30.0))) - y[i])
            gc += g * g
            c -= rate * g / np.sqrt(gc)
            if len(t):
                dw = g + decay * w[t]
                gw[t] += dw * dw
                w[t] -= rate * dw / np.sqrt(gw[t])
                dv = g * (total - vt) + decay * vt
                gv[t] += dv * dv
                v[t] -= rate * dv / np.sqrt(gv[t])
    return Machine(number, float(c), w, v)


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, seed: int = 5) -> Machine | None:
    """A machine of the labelled rows that aren't held out. The driver gets at most per_class sets of terms of each class."""
    named = labels.select(F.col(label_key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y is not null").filter(~held_out("k"))
    named = named.groupBy("k").agg(F.max((F.col("y") != 0).cast("int")).alias("y")).withColumn("u", unit_hash(F.lit(seed), F.col("k")))
    chosen = [named.filter(F.col("y") == y).orderBy("u", "k").limit(per_class) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 x per_class rows
    src = df.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("k"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("u", F.md5("t")))  # an id may have several rows
    src = src.withColumn("place", place).filter(F.col("place") <= per_class).select("y", "u", "t")

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for t in batch.column(2):
                found = [h for _, h in term_hashes([t.as_py()])]
                sets.append(np.unique(np.concatenate([np.zeros(0, np.int64), *found])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["y", "u", "terms"])

    rows = src.mapInArrow(termed, "y int, u double, terms binary").toPandas()
    if not len(rows):
        return None
    rows = rows.assign(bytes=rows["terms"].map(bytes)).sort_values(["u", "y", "bytes"], kind="stable")
    return fit([np.frombuffer(x, np.int32) for x in rows["terms"]], rows["y"].to_numpy())


def score_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of df."""
    machine = train(df, labels, key, text, label_key, label, per_class)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(machine)  # a size that TERMS and BITS set
    src = df.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("t"))
    schema = T.StructType([src.schema["doc_id"], src.schema["held_out"], T.StructField("score", T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            scores = shared.value.score(texts) if shared.value and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return src.mapInArrow(each, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Largest inner product becomes smallest angle by one more component, which lifts every
vector to the length of the longest. Codes are signs after learned rotations (each
alternates between the signs and the orthogonal matrix that fits them best), trained
on at most `SAMPLE` vectors. A code is cut into 16-bit substrings, each with a table
of its own. Codes within the radius agree with the query's in one substring up to the
substring's share of the radius, so probing every table with its share retrieves all
of them; whole codes are compared, and what is left is ranked by the inner product of
the original vectors in double precision. The radius is the one that holds `HOLD` of
the sample's true neighbours, which lie farther apart than those in the whole table.

Queries meet all other rows in blocks of bounded size; of a block each query keeps its
k best, so nothing grows with the number of pairs but the work itself, which does: it
is queries times rows. A query that finds fewer than k in a block takes the whole block.
`exact=True` leaves the codes out and finds the true neighbours.

Vectors that are null, zero or of a length other than the commonest, or hold null or
non-finite components, and rows without an id, take no part. Rows that share the
query's id aren't its candidates. Ties go to the smaller id. Fewer candidates than k:
all of them. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unit_hash

#: Bound of the training sample; rotations, each with a bit for each component; bits of a substring.
SAMPLE, ROTATIONS, SUB = 10_000, 2, 16
#: Share of the sample's true neighbours that the radius holds.
HOLD = 0.97
BLOCK, QUERIES = 16384, 4096


@dataclass
class Coder:
    longest: float
    mean: np.ndarray
    rotation: np.ndarray  # components by bits
    radius: int = 0

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """On the unit sphere; a query has nothing in the new component."""
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """A row of 16-bit substrings for each vector."""
        bits = (self.lifted(x, query) - self.mean) @ self.rotation > 0
        pad = -bits.shape[1] % SUB
        return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint16)


def learn(x: np.ndarray, k: int = 20, rotations: int = ROTATIONS, rounds: int = 25, hold: float = HOLD, longest: float | None = None, seed: int = 1) -> Coder:
    """A coder of sample vectors, and its radius from the neighbours of some of them."""
    rng = np.random.default_rng(seed)
    coder = Coder(longest or float(np.linalg.norm(x, axis=1).max()), np.zeros(0), np.zeros(0))
    lifted = coder.lifted(x, False)
    coder.mean = lifted.mean(0)
    v = lifted - coder.mean
    parts = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(v.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(r)
    both = np.hstack(parts)
    coder.rotation = both[:, : both.shape[1] // SUB * SUB or None]  # whole substrings
    probes = rng.choice(len(x), min(len(x), 200), replace=False)
    codes, own = coder.codes(x, False), coder.codes(x[probes], True)
    scores = x[probes] @ x.T
    scores[np.arange(len(probes)), probes] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    far = np.bitwise_count(codes[best] ^ own[:, None, :]).sum(2, dtype=np.int64)
    coder.radius = int(np.quantile(far, hold, method="higher")) if far.size else coder.rotation.shape[1]
    return coder


def shares(radius: int, tables: int) -> list[int]:
    """Radius of each table: a code within `radius` lies within one table's share. A share of -1: never alone."""
    a, rest = divmod(radius, tables)
    return [a if i <= rest else a - 1 for i in range(tables)]


def _tables(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each substring its distinct values, where their rows start, and the rows."""
    out = []
    for s in range(codes.shape[1]):
        order = np.argsort(codes[:, s], kind="stable")
        values, starts = np.unique(codes[order, s], return_index=True)
        out.append((values, np.append(starts, len(order)), order))
    return out


def in_radius(coder: Coder, tables: list, codes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Whether each row's code lies within the radius of each query's: probed in the tables, then verified.

    Where the probes would fetch more entries than there are rows, all codes are
    compared without the tables: the same rows, for less work.
    """
    own = shares(coder.radius, len(tables))
    words = lambda c: np.pad(c, ((0, 0), (0, -c.shape[1] % 4))).view(np.uint64)
    whole, ask = words(codes), words(probes)
    first = probes[:1]
    fetched = sum(int(np.diff(starts)[np.bitwise_count(values ^ first[0, s]) <= own[s]].sum()) for s, (values, starts, _) in enumerate(tables) if own[s] >= 0) if len(first) else 0
    if fetched >= len(codes):
        far = np.zeros((len(probes), len(codes)), np.uint16)
        for w in range(whole.shape[1]):
            far += np.bitwise_count(ask[:, w, None] ^ whole[None, :, w])
        return far <= coder.radius
    met = np.zeros((len(probes), len(codes)), bool)
    for s, (values, starts, order) in enumerate(tables):
        for v in np.unique(probes[:, s]) if own[s] >= 0 else ():
            hit = np.bitwise_count(values ^ v) <= own[s]
            met[np.ix_(probes[:, s] == v, order[np.repeat(hit, np.diff(starts))])] = True
    a, b = np.nonzero(met)
    met[a, b] = np.bitwise_count(ask[a] ^ whole[b]).sum(1) <= coder.radius
    return met


def search_block(coder: Coder | None, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, together: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the k best of a block for each query, by tables of substrings; without a coder of all rows."""
    if coder is not None:
        codes, probes = coder.codes(x, False), coder.codes(q, True)
        tables = _tables(codes)
    longest = np.sqrt((x * x).sum(1).max(initial=0))
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), together):
        part = q[at : at + together]
        other = ids[None, :] != qids[at : at + together, None]
        near = other & in_radius(coder, tables, codes, probes[at : at + together]) if coder is not None else other
        few = near.sum(1) < k
        near[few] = other[few]  # the whole block
        rough = np.where(near, part @ x.T, -np.inf)
        last = np.partition(rough, -k, axis=1)[:, -k] if k < len(x) else np.full(len(part), -np.inf)
        slack = 1e-9 * longest * np.sqrt((part * part).sum(1))  # the products' order of sums differs by less
        a, b = np.nonzero(near & (rough >= (last - slack)[:, None]))
        score = np.einsum("ij,ij->i", part[a], x[b])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((qids[at + a[top]], ids[b[top]], score[top]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3))


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col("v")
    src = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return src.filter(F.coalesce(fine, F.lit(False)))


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, block: int = BLOCK, queries: int = QUERIES, sample: int = SAMPLE, hold: float = HOLD, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`. exact: of all rows, without codes."""
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    spark = df.sparkSession
    rows = _valid(df, key, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("q")).collect()
    if not sizes:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    d, n, longest, nq = max(sizes, key=lambda r: (r.n, r.d))
    rows = rows.filter(F.size("v") == d)
    u = unit_hash(F.lit("sample"), F.col("id"))
    drawn = rows.withColumn("u", u).filter(F.col("u") <= min(1.0, (sample + 4 * sample**0.5) / n))  # a few more than `sample`
    picked = None if exact else drawn.orderBy("u", "id").select("v").limit(sample).toPandas()
    coder = spark.sparkContext.broadcast(None if exact else learn(np.stack(picked["v"]), k, hold=hold, longest=longest))  # of a size that d sets

    cand, ask = -(-n // block), -(-nq // queries) or 1
    part = lambda name, m: F.pmod(F.xxhash64(F.lit(name), F.col("id")), F.lit(m)).cast("int")
    every_one = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("c", part("c", cand)).withColumn("q", every_one(ask))
    right = rows.filter(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"), part("q", ask).alias("q"), every_one(cand).alias("c"))

    def met(_key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = search_block(coder.value, x["id"].to_numpy(), np.stack(x["v"]), q["qid"].to_numpy(), np.stack(q["qv"]), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True))).assign(c=_key[0])

    best = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(met, T.StructType([*out.fields, T.StructField("c", T.IntegerType())]))
    order = (F.desc("score"), F.asc("vec_id"))
    while cand > 64:  # of many blocks, the best of each 64 first
        cand = -(-cand // 64)
        best = best.withColumn("c", (F.col("c") / 64).cast("int"))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "c").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

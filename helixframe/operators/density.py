"""Hierarchical density clusters of tables of any size: spanning edges by rounds of blocks, and the condensed tree by ranges of heights.

1. Core distances come from `knn`, and with them the mutual reachability of near rows.
2. Spanning edges, in rounds: each component but the largest takes its lightest edge to
   another one. Its known edges tell that, unless a row of it may have a lighter one
   beyond its known neighbours: such rows meet all others in packed blocks, where a
   product in single precision leaves out what is surely too far. The time of that is
   quadratic, its memory bounded. Of edges as light as each other any will do.
3. The condensed tree is built from below. Edges are taken in ranges of their weights, of
   RANGE edges at most, each in a task of its own that gets the components' sums, not
   their rows. A weight of more edges than that is a range whose components are found and
   summed by joins and aggregates. So no task holds more than a range.
4. The clusters of the largest excess of mass follow from sums below, and their rows from
   pointers upwards, by doubling.

Edges of one weight are taken together, so the clusters don't depend on ties of the
spanning edges: at a height all that are joined by it become one component.

Rows with a null vector are noise. An empty table gives no rows.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec
from .blocks import TILE, block_pairs, places, unpacked, vectors_of
from .graph import components
from .neighbours import knn
from .ordered import running_sums
from .persist import shared_folder, written

#: Edges of a range of heights, and edges whose components one task finds; neighbours known of a row; pairs that are computed at once.
RANGE, NEAR, PAIRS = 1 << 17, 16, 1 << 16
#: What a range tells: 0 its nodes' roots, 1 components' sums, 2 the clusters of nodes that were small, 3 clusters that ended, with what they joined.
TOLD = "kind int, x long, y long, n long, c long, t double, below double, flag boolean"


def find(parent: dict[int, int] | list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def joined(edges: DataFrame, most: int = RANGE) -> DataFrame:
    """(node, root) of edges (u, v): the smallest node that can be reached; up to `most` edges in one task."""
    if edges.count() > most:
        return components(edges)

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf[["u", "v"]].to_numpy(np.int64), return_inverse=True)
        parent = list(range(len(names)))
        for a, b in at.reshape(-1, 2).tolist():
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"node": names, "root": names[[find(parent, i) for i in range(len(names))]]})

    return edges.select("u", "v", F.lit(0).alias("g")).groupBy("g").applyInPandas(roots, "node long, root long")


def nearest_outside(z: np.ndarray, ac: np.ndarray, ak: np.ndarray, reach: np.ndarray, y: np.ndarray, bc: np.ndarray, bk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(component, w, i, j): of each component of z (vectors, components, core distances) the lightest edge to a row of y in another one, if it is lighter than its reach."""
    comps, code = np.unique(ac, return_inverse=True)
    best, pair = np.full(len(comps), np.inf), np.full((len(comps), 2), -1)
    np.minimum.at(best, code, reach)
    if len(z) and len(y):
        other = places(bc, comps)
        middle = y.mean(0)
        scale = max(np.linalg.norm(z - middle, axis=1).max(), np.linalg.norm(y - middle, axis=1).max()) or 1.0
        room = 4 * (z.shape[1] + 8) * 2.0**-24
        halved = lambda w: (w / scale) ** 2 / 2
        a = np.ones((len(z), z.shape[1] + 1), np.float32)
        a[:, :-1] = (z - middle) / scale
        half = (((z - middle) / scale) ** 2).sum(1) / 2
        half, own = half.astype(np.float32), halved(ak)
        limit = halved(best)
        for first in range(0, len(y), TILE[1]):
            last = min(first + TILE[1], len(y))
            part = (y[first:last] - middle) / scale
            b = np.hstack([part, -(part * part).sum(1, keepdims=True) / 2]).astype(np.float32).T
            theirs, core = other[first:last], halved(bk[first:last]).astype(np.float32)
            for at in range(0, len(z), TILE[0]):
                mine = code[at : at + TILE[0]]
                live = ak[at : at + TILE[0]] < best[mine]  # no edge is lighter than a core distance
                if not live.any():
                    continue
                m = half[at : at + TILE[0], None] - a[at : at + TILE[0]] @ b
                np.maximum(m, core, out=m)
                m[mine[:, None] == theirs] = np.inf
                low = np.maximum(m.min(1), own[at : at + TILE[0]])
                np.minimum.at(limit, mine, low + room)
                rows = np.flatnonzero(live & (low - room <= limit[mine]) & np.isfinite(low))
                every_i, every_j = np.nonzero(m[rows] - room <= limit[mine[rows], None])
                every_i, every_j = rows[every_i] + at, every_j + first
                for some in range(0, len(every_i), PAIRS):
                    i, j = every_i[some : some + PAIRS], every_j[some : some + PAIRS]
                    use = (np.maximum(ak[i], bk[j]) < best[code[i]]) & (code[i] != other[j])
                    i, j = i[use], j[use]
                    diff = z[i] - y[j]
                    w = np.maximum(np.maximum(np.sqrt(np.einsum("ij,ij->i", diff, diff)), ak[i]), bk[j])
                    order = np.lexsort((w, code[i]))
                    order = order[np.flatnonzero(np.diff(code[i][order], prepend=-1))]
                    order = order[w[order] < best[code[i[order]]]]
                    best[code[i[order]]], pair[code[i[order]]] = w[order], np.stack([i[order], j[order]], 1)
                np.minimum(limit, halved(best), out=limit)
    found = np.flatnonzero(pair[:, 0] >= 0)
    return comps[found], best[found], pair[found, 0], pair[found, 1]


def spanning_edges(rows: DataFrame, samples: int, near: int = NEAR) -> DataFrame:
    """(a, b, w) of rows (node, v): edges of mutual reachability that hold a minimum spanning tree."""
    single = isinstance(rows.schema["v"].dataType.elementType, T.FloatType)
    rows = rows.select("node", "v" if single else vec.as_double("v").alias("v")).filter("v is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    k = max(near, samples - 1)
    close = written(knn(rows, rows, k, "euclidean", "node", "v", skip_self=True))
    known = close.groupBy(F.col("query_id").alias("node")).agg(F.max(F.when(F.col("rank") == min(samples, n) - 1, F.col("distance"))).alias("core"), F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("least"))
    rows = rows.join(known, "node", "left").withColumn("core", F.coalesce("core", F.lit(0.0))).withColumn("least", F.coalesce("least", F.lit(float("inf"))))
    rows = written(rows.withColumn("c", F.col("node")))
    side = lambda name: rows.select(F.col("node").alias(name), F.col("core").alias(f"{name}k"))
    pairs = close.select(F.least("query_id", "neighbour_id").alias("a"), F.greatest("query_id", "neighbour_id").alias("b"), F.col("distance").alias("d")).dropDuplicates(["a", "b"])
    pairs = written(pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", F.greatest("d", "ak", "bk").alias("w")))
    way = lambda x, y, a, b: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(a).alias("a"), F.col(b).alias("b"), F.col("w"))
    lightest = lambda edges: edges.groupBy("x").agg(F.min(F.struct("w", "a", "b", "y")).alias("e")).select("x", "e.*")

    def outside(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = unpacked(x, "a"), unpacked(y, "b")
        bc = unpacked(y, "bc")
        c, w, i, j = nearest_outside(vectors_of(x, "av", len(a), single), unpacked(x, "ac"), unpacked(x, "ak"), unpacked(x, "reach"), vectors_of(y, "bv", len(b), single), bc, unpacked(y, "bk"))
        return pa.table({"x": pa.array(c, pa.int64()), "w": pa.array(w, pa.float64()), "a": pa.array(a[i], pa.int64()), "b": pa.array(b[j], pa.int64()), "y": pa.array(bc[j], pa.int64())})

    taken = []
    while True:
        largest = rows.groupBy("c").count().orderBy(F.desc("count"), "c").limit(2).collect()
        if len(largest) < 2:
            break
        best = written(lightest(pairs.select(F.inline(F.array(way("x", "y", "a", "b"), way("y", "x", "b", "a"))))).filter(F.col("x") != largest[0]["c"]))
        reach = best.select(F.col("x").alias("c"), F.col("w").alias("reach"))
        asked = rows.filter(F.col("c") != largest[0]["c"]).join(reach, "c", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))).filter(F.greatest("least", "core") < F.col("reach"))
        asked = written(asked.select(F.col("node").alias("a"), F.col("c").alias("ac"), F.col("core").alias("ak"), "reach", F.col("v").alias("av")))
        if asked.limit(1).count():
            right = rows.select(F.col("node").alias("b"), F.col("c").alias("bc"), F.col("core").alias("bk"), F.col("v").alias("bv"))
            found = block_pairs(asked, right, outside, "x long, w double, a long, b long, y long", ("av", "bv"), size)
            best = written(lightest(best.unionByName(written(found))))
        taken.append(best.select("a", "b", "w"))
        if not best.limit(1).count():
            break  # distances that are no numbers
        roots = written(joined(best.select(F.col("x").alias("u"), F.col("y").alias("v"))))
        top = lambda name: F.coalesce(f"{name}_root", name)
        to = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        rows = written(rows.join(best.select(F.col("x").alias("c"), "w"), "c", "left").join(to("c"), "c", "left").select("node", "v", "core", F.greatest("least", "w").alias("least"), top("c").alias("c")))
        pairs = written(pairs.join(to("x"), "x", "left").join(to("y"), "y", "left").select(top("x").alias("x"), top("y").alias("y"), "a", "b", "w").filter("x <> y"))
    edges = rows.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w")).limit(0)
    for more in taken:
        edges = edges.unionByName(more)
    return written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").dropDuplicates(["a", "b"]))


def level(height: float) -> float:
    return 1 / height if height > 0 else 1e12


def range_told(pdf: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """TOLD of a range: edges (a, b, w) and, where w is null, the sums (a; n, c, t, below) of components of more than one row."""
    edges = pdf[pdf["w"].notna()].sort_values(["w", "a", "b"])
    sums = pdf[pdf["w"].isna()]
    names, ends = np.unique(edges[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    ends, heights = ends.reshape(-1, 2).tolist(), edges["w"].tolist()
    parent, n = list(range(len(names))), [1] * len(names)
    cluster: list[tuple[int, float, float | None] | None] = [None] * len(names)
    at = np.searchsorted(names, sums["a"].to_numpy(np.int64)).tolist()
    for i, m, c, t, below in zip(at, sums["n"], sums["c"], sums["t"], sums["below"], strict=True):
        n[i] = int(m)
        if m >= min_size:
            cluster[i] = (int(c), t, None if pd.isna(below) else below)
    small = {i: [i] for i in range(len(names)) if n[i] < min_size}
    began_small = set(small)
    told: list[tuple] = []
    e = 0
    while e < len(ends):
        height, merged = heights[e], {}
        while e < len(ends) and heights[e] == height:
            a, b = find(parent, ends[e][0]), find(parent, ends[e][1])
            e += 1
            if a != b:
                one, two = merged.pop(a, [a]), merged.pop(b, [b])
                one, two = (one, two) if len(one) >= len(two) else (two, one)
                one += two
                parent[max(a, b)] = min(a, b)
                merged[min(a, b)] = one
        lam = level(height)
        for root, parts in merged.items():
            parts.sort()
            total = sum(n[p] for p in parts)
            big, little = [p for p in parts if n[p] >= min_size], [p for p in parts if n[p] < min_size]
            inside = [i for p in little for i in small.pop(p)]
            if len(big) == 1:
                c, t, below = cluster[big[0]]
                own = (c, t + sum(n[p] for p in little) * lam, below)
            elif total < min_size:
                own, small[root] = None, inside
            else:
                c, below = int(names[parts[-1]]), None
                for p in big:
                    was, t, under = cluster[p]
                    mass = t - n[p] * lam
                    chosen = under is None or mass >= under
                    told.append((3, was, None, None, c, None, None, chosen))
                    below = (below or 0.0) + (mass if chosen else under)
                own = (c, total * lam, below)
            n[root], cluster[root] = total, own
            if own:
                told += [(2, int(names[i]), None, None, own[0], None, None, None) for i in inside]
    for i, name in enumerate(names.tolist()):
        root = find(parent, i)
        told.append((0, name, int(names[root]), None, None, None, None, i in began_small and n[root] < min_size and root != i))
        if root == i:
            told.append((1, name, None, n[i], *(cluster[i] or (None, None, None)), None))
    out = pd.DataFrame(told, columns=["kind", "x", "y", "n", "c", "t", "below", "flag"])
    return out.astype({"kind": "int32", "x": "Int64", "y": "Int64", "n": "Int64", "c": "Int64", "t": float, "below": float, "flag": object})


def height_told(edges: DataFrame, sums: DataFrame, height: float, min_size: int) -> DataFrame:
    """TOLD of edges (a, b) of one height, however many; sums: (x, n, c, t, below)."""
    lam, none = F.lit(level(height)), lambda kind: F.lit(None).cast(kind)
    ends = joined(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).join(sums.withColumnRenamed("x", "node"), "node", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    big = F.col("n") >= min_size
    mass = F.col("t") - F.col("n") * lam
    ends = written(ends.withColumn("chosen", F.when(big, F.col("below").isNull() | (mass >= F.col("below")))).withColumn("value", F.when(F.col("chosen"), mass).otherwise(F.col("below"))))
    whole = ends.groupBy("root").agg(F.sum("n").alias("total"), F.count_if(big).alias("bigs"), F.sum(F.when(big, 0).otherwise(F.col("n"))).alias("little"), F.max("node").alias("new"), F.max(F.when(big, F.col("c"))).alias("was"), F.sum("t").alias("t"), F.sum("below").alias("below"), F.sum("value").alias("value"))
    one, grown = F.col("bigs") == 1, F.col("total") >= min_size
    whole = written(whole.select(
        "root", "total", "bigs", F.when(one, F.col("was")).when(grown, F.col("new")).alias("to"), F.when(one, F.col("t") + F.col("little") * lam).when(grown, F.col("total") * lam).alias("t"),
        F.when(one, F.col("below")).when(F.col("bigs") > 1, F.col("value")).alias("below"),
    ))
    both = ends.select("node", "root", "n", "c", "chosen").join(whole.select("root", "total", "bigs", "to"), "root")
    row = lambda kind, x, y, n, c, t, below, flag: [F.lit(kind).alias("kind"), F.col(x).alias("x"), y.cast("long").alias("y"), n.cast("long").alias("n"), c.cast("long").alias("c"), t.cast("double").alias("t"), below.cast("double").alias("below"), flag.cast("boolean").alias("flag")]
    nil = none("long")
    told = both.select(*row(0, "node", F.col("root"), nil, nil, nil, nil, (F.col("total") < min_size) & (F.col("node") != F.col("root"))))
    told = told.unionByName(whole.select(*row(1, "root", nil, F.col("total"), F.col("to"), F.col("t"), F.col("below"), nil)))
    told = told.unionByName(both.filter((F.col("n") < min_size) & F.col("to").isNotNull()).select(*row(2, "node", nil, nil, F.col("to"), nil, nil, nil)))
    return told.unionByName(both.filter((F.col("n") >= min_size) & (F.col("bigs") > 1)).select(*row(3, "c", nil, nil, F.col("to"), nil, nil, F.col("chosen"))))


def heights(edges: DataFrame, most: int) -> list[tuple[float, float, bool]]:
    """(above, up to, is one height): ranges of the weights in order, of `most` edges at most unless of one height."""
    n = edges.count()
    if n <= most:
        return [(-np.inf, np.inf, False)]
    pieces = -(-4 * n // most)
    cuts = set(edges.approxQuantile("w", [i / pieces for i in range(1, pieces)], 0.25 / pieces))
    full = {r["w"] for r in edges.groupBy("w").count().filter(F.col("count") > most // 4).collect()}  # so many of them at most as ranges
    cuts = sorted({*cuts, *full, *(float(np.nextafter(w, -np.inf)) for w in full)})
    return [(a, b, b in full) for a, b in zip([-np.inf, *cuts], [*cuts, np.inf], strict=True)]


def condensed(edges: DataFrame, min_size: int, most: int = RANGE) -> tuple[DataFrame, int]:
    """TOLD of all ranges of spanning edges (a, b, w), and how many ranges there were."""
    spark = edges.sparkSession
    base, paths = f"{shared_folder(spark)}/heights-{uuid4().hex}", []
    read = lambda *at: spark.read.schema(TOLD).parquet(*at)
    sums = spark.createDataFrame([], "x long, n long, c long, t double, below double")
    ranges = heights(edges, most)
    for i, (above, upto, one) in enumerate(ranges):
        part = edges.filter((F.col("w") > above) & (F.col("w") <= upto) & (F.col("a") != F.col("b")))
        if i < len(ranges) - 1:
            edges = written(edges.filter(F.col("w") > upto)) if i == 0 else edges.filter(F.col("w") > upto)
        if one:
            told = height_told(part, sums, upto, min_size)
        else:
            ends = part.select(F.explode(F.array("a", "b")).alias("x")).distinct()
            state = sums.join(ends, "x", "left_semi").select(F.col("x").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"), "n", "c", "t", "below")
            every = part.select("a", "b", "w").unionByName(state, allowMissingColumns=True).withColumn("g", F.lit(0))
            told = every.groupBy("g").applyInPandas(lambda pdf: range_told(pdf, min_size), TOLD)
        told.write.parquet(f"{base}/{i}")
        paths.append(f"{base}/{i}")
        if i < len(ranges) - 1:
            moved = read(paths[-1]).filter("kind = 0")
            sums = written(sums.join(moved.select("x"), "x", "left_anti").unionByName(read(paths[-1]).filter("kind = 1").select(*sums.columns)))
            to = lambda name: moved.select(F.col("x").alias(name), F.col("y").alias(f"{name}_root"))  # noqa: B023, E731
            edges = written(edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"), "w"))
    return read(*paths), len(ranges)


def tops(ended: DataFrame) -> DataFrame:
    """(c, top) of clusters (c, parent, chosen): the last chosen one upwards from c, c included, or null."""
    now = written(ended.select("c", F.col("parent").alias("to"), F.when(F.col("chosen"), F.col("c")).alias("top")))
    while now.filter("to is not null").limit(1).count():
        for _ in range(2):
            now = now.join(now.select(F.col("c").alias("to"), F.col("to").alias("far"), F.col("top").alias("up")), "to", "left").select("c", F.col("far").alias("to"), F.coalesce("up", "top").alias("top"))
        now = written(now)
    return now.select("c", "top")


def density_clusters(df: DataFrame, key: str, vector: str, min_size: int = 5, min_samples: int | None = None, most: int = RANGE) -> DataFrame:
    """(key, cluster): hierarchical density clusters, numbered by their smallest keys, -1 noise.

    Mutual reachability, minimum spanning tree, then of the condensed tree the clusters
    of the largest excess of mass; never the whole table. most: edges of a range of heights.
    """
    if min_size < 2:
        raise ValueError("a cluster has two rows at least")
    rows = written(df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.monotonically_increasing_id().alias("node")))
    told, ranges = condensed(spanning_edges(rows, min_samples or min_size), min_size, most)
    at = rows.select("k", F.col("node").alias("x"))
    for _ in range(min(ranges, min_size) - 1):  # small components that were joined in one range and left in a later one
        at = at.join(told.filter("kind = 0 and flag").select("x", "y"), "x", "left").select("k", F.coalesce("y", "x").alias("x"))
    ended = told.filter("kind = 3").select(F.col("x").alias("c"), F.col("c").alias("parent"), F.col("flag").alias("chosen"))
    found = at.join(told.filter("kind = 2").select("x", "c"), "x", "left").join(tops(ended), "c", "left").select("k", "top")
    found = written(found)
    first = written(found.filter("top is not null").groupBy("top").agg(F.min("k").alias("first")).withColumn("one", F.lit(1)))
    numbers = running_sums(first, "first", {"number": "one"}, before=True).select("top", "number")
    return found.join(numbers, "top", "left").select(F.col("k").alias(key), F.coalesce("number", F.lit(-1)).cast("int").alias("cluster"))

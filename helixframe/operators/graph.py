"""Graphs as tables of edges: components, modularity and communities, all joins and aggregates; only stopping tests reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .persist import written

#: Shares of the nodes (one in so many) that may move together, tried one after another.
SHARES = (2, 8)
#: A rise of the modularity that is worth another turn.
RISE = 2e-3
#: Links of a partition that is kept for the turns.
PART = 1 << 16


def pointed(pointers: DataFrame) -> DataFrame:
    """(node, root): where the pointers (node, to) of a forest end, by doubling, three times for each table that is written. A root points to itself, and every `to` is a node."""
    now = written(pointers)
    while True:
        start = now.select("node", F.col("to").alias("was"))
        for _ in range(3):
            now = now.join(now.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))
        jumped = written(now.join(start, "node"))
        now = jumped.select("node", "to")
        if not jumped.filter("to <> was").limit(1).count():
            return now.withColumnRenamed("to", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (u, v): the smallest node that can be reached.

    In a round every node hooks to its smallest neighbour, if that is smaller, pointers are
    followed to their ends, and what is joined becomes one node.
    """
    both = F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return _joined(written(edges.select(both).distinct()))


def _joined(links: DataFrame) -> DataFrame:
    """`components` of written links (u, v) in both directions."""
    members = links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    while True:
        links = links.filter("u <> v")
        if not links.limit(1).count():
            return members
        hooks = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("to"))
        roots = pointed(hooks)
        members = written(members.join(roots.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        links = written(links.join(roots.toDF("u", "a"), "u").join(roots.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w): every edge (src, dst, weight) in both directions, repeated ones added up."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("weight").cast("double").alias("w"))
    return edges.select(F.inline(F.array(way("src", "dst"), way("dst", "src")))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """Of the communities (node, cluster) of edges (src, dst, weight)."""
    links = both_ways(edges)
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    where = members.select(F.col("node").alias("n"), F.col("cluster").alias("c"))
    by = links.join(where.select(F.col("n").alias("src"), F.col("c").alias("a")), "src").join(where.select(F.col("n").alias("dst"), F.col("c").alias("b")), "dst")
    inside = F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)
    return _quality(by.select(F.col("a").alias("c"), F.col("w").alias("k"), inside.alias("inside")), total)


def _quality(rows: DataFrame, total: float) -> float:
    """Modularity of communities c by the weights k, and of them those inside, of its rows."""
    sums = rows.groupBy("c").agg(F.sum("k").alias("k"), F.sum("inside").alias("inside"))
    return float(sums.agg(F.sum(F.col("inside") / total - F.pow(F.col("k") / total, 2))).first()[0])


def options(links: DataFrame, where: DataFrame, total: float, parts: int) -> DataFrame:
    """(n, k, loop, c, best, inside): of each node (n, k, loop, c) the neighbouring community of the largest gain, its own on a tie, and the weight inside its own.

    Links (src, dst, w) in both directions, without loops, in `parts` partitions by src, meet the nodes once and are moved once: nodes tell their neighbours where they are.
    """
    at = where.join(where.groupBy("c").agg(F.sum("k").alias("mass")), "c")
    told = links.join(at.select(F.col("n").alias("src"), F.col("c").alias("to"), F.col("mass").alias("there")).hint("shuffle_hash"), "src")
    to = told.select(F.col("dst").alias("n"), "to", "there", "w").repartition(parts, "n").groupBy("n", "to").agg(F.sum("w").alias("w"), F.max("there").alias("there"))
    both = at.join(to, "n", "left")
    gain = lambda w, mass: F.round(w - F.col("k") * mass / F.lit(total), 9)
    other = F.max(F.when(F.col("to") != F.col("c"), F.struct(gain(F.col("w"), F.col("there")).alias("g"), (-F.col("to")).alias("neg"))))
    same = F.coalesce(F.max(F.when(F.col("to") == F.col("c"), F.col("w"))), F.lit(0.0))
    by = both.groupBy("n").agg(*(F.max(x).alias(x) for x in ("k", "loop", "c", "mass")), other.alias("b"), same.alias("same"))
    leaves = F.col("b.g") > gain(F.col("same"), F.col("mass") - F.col("k"))
    return by.select("n", "k", "loop", "c", F.when(leaves, -F.col("b.neg")).otherwise(F.col("c")).alias("best"), (F.col("same") + F.col("loop")).alias("inside"))


def _moved(known: DataFrame, turn: int, share: int) -> DataFrame:
    """(n, k, loop, c) of known options, after every node in `share`, by a hash of the turn, has moved."""
    may = F.pmod(F.xxhash64("n", F.lit(turn)), F.lit(share)) == 0
    return known.select("n", "k", "loop", F.when(may, F.col("best")).otherwise(F.col("c")).alias("c"))


def _settled(links: DataFrame, total: float, rise: float) -> DataFrame:
    """(n, c): communities of one node each, after moves until no node gains by one, or no share of those that do raises the modularity by `rise`. The modularity of a turn comes with its options."""
    rows = F.col("src") == F.col("dst")
    start = links.groupBy(F.col("src").alias("n")).agg(F.sum("w").alias("k"), F.sum(F.when(rows, F.col("w")).otherwise(0.0)).alias("loop"))
    parts = 1 + links.count() // PART
    near = links.filter(~rows).repartition(parts, "src").persist()
    known = written(options(near, written(start.select("n", "k", "loop", F.col("n").alias("c"))), total, parts))
    quality, turn, step = _quality(known, total), 0, 0
    while step < len(SHARES) and known.filter("best <> c").limit(1).count():
        tried = written(options(near, _moved(known, turn, SHARES[step]), total, parts))
        turn += 1
        better = _quality(tried, total)
        if better > quality + rise:
            known, quality, step = tried, better, 0
        else:
            step += 1  # fewer at once: nodes that moved together undid each other
    near.unpersist()
    return known.select("n", "c")


def connected(links: DataFrame, where: DataFrame) -> DataFrame:
    """(n, c): communities split into their connected parts, each named by its smallest node. That never lowers the modularity."""
    a, b = where.select(F.col("n").alias("src"), F.col("c").alias("a")), where.select(F.col("n").alias("dst"), F.col("c").alias("b"))
    inside = links.join(a, "src").join(b, "dst").filter((F.col("a") == F.col("b")) & (F.col("src") != F.col("dst")))
    parts = _joined(written(inside.select(F.col("src").alias("u"), F.col("dst").alias("v"))))
    return where.select("n").join(parts.withColumnRenamed("node", "n"), "n", "left").select("n", F.coalesce("root", "n").alias("c"))


def communities(edges: DataFrame, least: int = 2, rise: float = RISE) -> DataFrame:
    """(node, cluster): modularity communities of (src, dst, weight), ids whole numbers; small ones -1.

    Nodes move to the neighbouring community of the largest gain, a share of them at once,
    until none gains or no share raises the modularity by `rise`. Communities are then refined: each
    is split into its connected parts. The parts become nodes, and it starts again, until
    nothing changes. Every community is connected.
    """
    links = written(both_ways(edges))
    members = written(links.select(F.col("src").alias("node")).distinct().withColumn("at", F.col("node")))
    total = links.agg(F.sum("w")).first()[0]
    while total:
        parts = written(connected(links, _settled(links, total, rise)))
        if not parts.filter("n <> c").limit(1).count():
            break
        members = written(members.join(parts.select(F.col("n").alias("at"), "c"), "at").select("node", F.col("c").alias("at")))
        a, b = parts.select(F.col("n").alias("src"), F.col("c").alias("a")), parts.select(F.col("n").alias("dst"), F.col("c").alias("b"))
        links = written(links.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    sizes = members.groupBy("at").count()
    return members.join(sizes, "at").select("node", F.when(F.col("count") >= least, F.col("at")).otherwise(-1).alias("cluster"))

"""Panels of sequences and categories: routing, caps, masks around boundaries, grouped distances, tracks."""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .intervals import near_join, position_mask
from .neighbours import cross_similarity


def contains_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str, gram: int = 4) -> DataFrame:
    """Left rows with the first right key that contains theirs or is contained in it.

    Keys meet by the grams of `gram` letters that they share and are then compared;
    a shorter key than that meets the keys that begin or end anywhere with it through
    all their pieces of its length.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - gram + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(gram))))
    a = left.select(F.col(left_key).alias("_l")).distinct()
    b = right.select(F.col(right_key).alias("_r"), F.col(order).alias("_o"))
    short = lambda c: F.length(c) < gram
    # of the shorter key one gram is enough, the longer one offers all of its
    one = lambda c: F.substring(c, 1, gram)
    long_a, long_b = a.filter(~short(F.col("_l"))), b.filter(~short(F.col("_r")))
    met = long_a.withColumn("_g", one(F.col("_l"))).join(long_b.withColumn("_g", F.explode(grams(F.col("_r")))), "_g").drop("_g")
    met = met.unionByName(long_a.withColumn("_g", F.explode(grams(F.col("_l")))).join(long_b.withColumn("_g", one(F.col("_r"))), "_g").drop("_g"))
    pieces = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram - 1)), lambda n: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, n))))))
    met = met.unionByName(a.filter(short(F.col("_l"))).withColumn("_g", F.col("_l")).join(b.withColumn("_g", pieces(F.col("_r"))), "_g").drop("_g"))
    met = met.unionByName(a.withColumn("_g", pieces(F.col("_l"))).join(b.filter(short(F.col("_r"))).withColumn("_g", F.col("_r")), "_g").drop("_g"))
    ok = met.filter(F.contains("_l", "_r") | F.contains("_r", "_l"))
    first = ok.groupBy("_l").agg(F.min_by("_r", F.struct("_o", "_r")).alias(right_key))
    return left.join(first, F.col(left_key) == F.col("_l"), "left").drop("_l")


def route(wanted: DataFrame, sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, source): the first source that has it; `none` for what no source has."""
    out, rest = None, wanted.select(key).distinct()
    for name, df in sources:
        hit = rest.join(df.select(key), key, "left_semi").withColumn("source", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(df.select(key), key, "left_anti")
    last = rest.withColumn("source", F.lit("none"))
    return last if out is None else out.unionByName(last)


def capped_panel(df: DataFrame, group: str, organism: str, order: str, cap: int) -> DataFrame:
    """At most `cap` rows a group, of each organism (first two words) the first."""
    species = F.concat_ws(" ", F.slice(F.split(F.trim(organism), r"\s+"), 1, 2))
    one = df.withColumn("_s", species).withColumn("_k", F.row_number().over(Window.partitionBy(group, "_s").orderBy(order))).filter("_k = 1")
    return one.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_k") <= cap).drop("_s", "_k")


def boundary_masks(positions: DataFrame, genes: DataFrame, seq: str, pos: str = "pos", reach: int = 20) -> DataFrame:
    """Positions with `coding`, `boundary` (within `reach` of a gene's end) and `interior` (coding and no boundary) as 0/1."""
    coding = position_mask(positions.select(seq, pos), genes, seq, pos, "coding")
    ends = genes.select(seq, F.explode(F.array("start", "end")).alias("_b"))
    wide = ends.select(seq, (F.col("_b") - reach).alias("start"), (F.col("_b") + reach + 1).alias("end"))
    edge = position_mask(positions.select(seq, pos), wide, seq, pos, "boundary")
    both = coding.join(edge.distinct(), [seq, pos])
    return both.withColumn("interior", (F.col("coding") * (1 - F.col("boundary"))).cast("int"))


def found_boundaries(ends: DataFrame, peaks: DataFrame, seq: str, end: str, peak: str, tolerance: int = 50) -> DataFrame:
    """(sequence, n, n_found): how many ends have a peak near."""
    near = near_join(ends, peaks, seq, end, peak, tolerance).select(seq, end).distinct().withColumn("_hit", F.lit(1))
    return ends.join(near, [seq, end], "left").groupBy(seq).agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("n_found"))


def group_distances(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group_a, group_b, n, mean): cosine distances of all pairs of rows of two groups, from the groups' sums, so that no pair is formed."""
    c = cross_similarity(df, group, vector, squares=False)
    return c.select(F.col("label_a").alias("group_a"), F.col("label_b").alias("group_b"), F.col("n_pairs").alias("n"), (1 - F.col("total") / F.col("n_pairs")).alias("mean"))


def codon_distances(df: DataFrame, codon: str, amino: str, vector: str, stop: str = "*") -> DataFrame:
    """(kind, n, mean): cosine distances between stop codons, between stop and sense codons, between codons of one amino acid and of two.

    amino: the amino acid of a codon, `stop` for a stop codon. A codon with several rows counts by each.
    """
    rows = df.filter(F.col(codon).isNotNull() & F.col(amino).isNotNull())
    c = group_distances(rows, amino, vector)
    a, b = F.col("group_a"), F.col("group_b")
    kind = F.when((a == stop) & (b == stop), "stop-stop").when((a == stop) | (b == stop), "stop-sense").when(a == b, "synonymous").otherwise("between")
    return c.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))


def top_errors(df: DataFrame, key: str, truth: str, score: str, threshold: float = 0.5, most: int = 20) -> DataFrame:
    """(kind, rank, key, score): the `most` worst false negatives, lowest score first, and false positives, highest first; ties by key."""
    t, s = F.col(truth), F.col(score)
    fn = df.filter(t & (s < threshold)).orderBy(s.asc(), key).limit(most).select(F.lit("fn").alias("kind"), key, s.alias("score"), s.alias("_o"))
    fp = df.filter(~t & (s >= threshold)).orderBy(s.desc(), key).limit(most).select(F.lit("fp").alias("kind"), key, s.alias("score"), (-s).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("_o", key))  # 2 x most rows
    return fn.unionByName(fp).withColumn("rank", rank).drop("_o")


def category_scores(manifest: DataFrame, calls: DataFrame, key: str, category: str, truth: str) -> DataFrame:
    """(tool, category, n, evaluated, sensitivity, mean_score) of calls (tool, key, pred, score).

    Sensitivity takes the rows that a tool evaluated; the mean score counts the others as 0.
    """
    tools = calls.select("tool").distinct()
    every = manifest.select(key, category, truth).join(tools)  # a row a tool: few
    met = every.join(calls, ["tool", key], "left")
    hit, known = F.col(truth) & F.col("pred"), F.col("pred").isNotNull()
    return met.groupBy("tool", category).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("evaluated"),
        F.try_divide(F.count_if(hit).cast("double"), F.count_if(F.col(truth) & known).cast("double")).alias("sensitivity"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"),
    )


def panel_census(df: DataFrame, group: str, species: str) -> DataFrame:
    """(group, n, n_species): entries of a panel and how many species they name."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(species).alias("n_species"))


def coding_first(df: DataFrame, coding: str, lineage: str, name: str) -> DataFrame:
    """Rows in two parts: coding ones by lineage and name, then the others by name."""
    return df.orderBy(F.desc(coding), F.when(F.col(coding), F.col(lineage)).otherwise(F.lit("")), name)


def hit_summary(hits: DataFrame, query: str, target: str) -> DataFrame:
    """One row: has_hits, n_hits, n_queries, n_targets, and them as a sentence."""
    n = hits.agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct(query).alias("n_queries"), F.count_distinct(target).alias("n_targets"))
    text = F.format_string("%d hits of %d queries in %d targets", "n_hits", "n_queries", "n_targets")
    return n.select((F.col("n_hits") > 0).alias("has_hits"), "n_hits", "n_queries", "n_targets", text.alias("summary"))


def offset_tracks(df: DataFrame, seq: str, pos: str, vector: str, offsets: tuple[int, ...] = (1, 3)) -> DataFrame:
    """cos<k> at each position with the one k ahead, 0 at the tail, and the norm."""
    v = vec.as_double(vector)
    order = Window.partitionBy(seq).orderBy(pos)
    rows = df.select(seq, pos, v.alias("v"), vec.norm(v).alias("norm"))
    for k in offsets:
        rows = rows.withColumn(f"_v{k}", F.lead("v", k).over(order))
    return rows.select(seq, pos, "norm", *(F.when(F.col(f"_v{k}").isNull(), 0.0).otherwise(vec.cosine("v", f"_v{k}")).alias(f"cos{k}") for k in offsets))


def failing_groups(df: DataFrame, group: str | Column, failed: str | Column, most: int = 20) -> DataFrame:
    """(group, failures, n, rate): the groups with most failures, ties by name."""
    g, f = (F.col(x) if isinstance(x, str) else x for x in (group, failed))
    by = df.groupBy(g.alias("group")).agg(F.count_if(f).alias("failures"), F.count(F.lit(1)).alias("n"))
    return by.filter("failures > 0").withColumn("rate", F.col("failures") / F.col("n")).orderBy(F.desc("failures"), "group").limit(most)


def cutoff_counts(df: DataFrame, score: str, cutoffs: list[float]) -> DataFrame:
    """(cutoff, n): rows at or above each cutoff, in one aggregation."""
    one = df.agg(*(F.count_if(F.col(score) >= c).alias(f"c{i}") for i, c in enumerate(cutoffs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"c{i}").alias("n")) for i, c in enumerate(cutoffs)))))


def best_setting(df: DataFrame, item: str, setting: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(mean value of each setting, best setting of each item): ties to the smaller setting."""
    means = df.groupBy(setting).agg(F.avg(value).alias("mean"))
    best = df.groupBy(item).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(setting)).alias("n"))).alias("b"))
    return means, best.select(item, (-F.col("b.n")).alias(setting), F.col("b.v").alias(value))


#: Mean of an overlap from which its expected information comes from moments instead of a sum of terms.
LARGE = 2000.0


def expected_information(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Expected sum of k/n log(nk / xy) over k, the overlap of a class of x and one of y rows out of n that are dealt at random.

    Of small overlaps the terms are summed, with weights from ratios of neighbours; of
    large ones (a mean of `LARGE`) k log(k / mean) is expanded about the mean: with the
    moments up to the fourth, what is left out is some 10 / mean squared. Work doesn't
    depend on n.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    mean = x * y / n
    out = np.zeros(len(x))
    for i in np.flatnonzero(mean < LARGE):
        a, b = int(max(x[i], y[i])), int(min(x[i], y[i]))
        low, mode = max(0, a + b - n), int((a + 1) * (b + 1) // (n + 2))
        reach = int(40 * (mean[i] + 1) ** 0.5) + 60
        k = np.arange(max(low, mode - reach), min(b, mode + reach) + 1, dtype=float)
        ratio = np.log((a - k[:-1]) * (b - k[:-1])) - np.log((k[:-1] + 1) * (n - a - b + k[:-1] + 1))
        weight = np.concatenate([[0.0], np.cumsum(ratio)])
        weight = np.exp(weight - weight.max())
        weight /= weight.sum()
        some = k > 0
        out[i] = (weight[some] * k[some] / n * np.log(n * k[some] / (x[i] * y[i]))).sum()
    big = np.flatnonzero(mean >= LARGE)
    if len(big):
        p, draws, m = x[big] / n, y[big], mean[big]
        q, rest = 1 - p, n - draws
        var = m * q * rest / (n - 1)
        third = var * (1 - 2 * p) * (n - 2 * draws) / max(n - 2, 1)
        flat = 3 * var * var + var  # of a nearly normal count
        out[big] = (var / (2 * m) - third / (6 * m**2) + flat / (12 * m**3)) / n
    return out


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> float:
    """Of two labelings, by the mean of their entropies. Rows are counted once; what reaches the driver is how many labels have each size."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    rows, cols = cells.groupBy("a").agg(F.sum("k").alias("x")), cells.groupBy("b").agg(F.sum("k").alias("y"))
    sizes = [{r[0]: r[1] for r in side.groupBy(side.columns[1]).count().collect()} for side in (rows, cols)]  # distinct sizes: at most the root of twice the rows
    n = sum(size * many for size, many in sizes[0].items())
    if n == 0 or all(sum(s.values()) == 1 for s in sizes):
        return 1.0
    mutual = cells.join(rows.withColumnRenamed("a", "_a"), F.col("a").eqNullSafe(F.col("_a"))).join(cols.withColumnRenamed("b", "_b"), F.col("b").eqNullSafe(F.col("_b")))
    mutual = mutual.agg(F.sum(F.col("k") / n * F.log(n * F.col("k") / (F.col("x") * F.col("y"))))).first()[0]
    left, right = (np.array(sorted(s.items()), float) for s in sizes)
    expected = sum(float((many * right[:, 1] * expected_information(np.full(len(right), x), right[:, 0], n)).sum()) for x, many in left)
    entropy = lambda s: -sum(many * (size / n) * log(size / n) for size, many in s.items())
    top = (entropy(sizes[0]) + entropy(sizes[1])) / 2 - expected
    return 1.0 if abs(top) < 1e-15 else (mutual - expected) / top

"""Evaluation and summary aggregates. Every one is a groupBy with partial aggregation; none collects rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sums


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def counts(truth: str | Column, pred: str | Column) -> dict[str, Column]:
    """tp, fp, tn, fn of two boolean columns; nulls count nowhere."""
    t, p = _col(truth), _col(pred)
    return {"tp": F.count_if(t & p), "fp": F.count_if(~t & p), "tn": F.count_if(~t & ~p), "fn": F.count_if(t & ~p)}


def binary_metrics(df: DataFrame, truth: str | Column, pred: str | Column, by: Sequence[str] = (), undefined: float | None = 0.0) -> DataFrame:
    """tp, fp, tn, fn, n, accuracy, precision, recall, specificity, f1; 0/0 is `undefined`."""
    base = df.groupBy(*by).agg(*(c.cast("long").alias(k) for k, c in counts(truth, pred).items()))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(undefined).cast("double"))
    return base.select(
        "*", (tp + fp + tn + fn).alias("n"), safe(tp + tn, tp + fp + tn + fn).alias("accuracy"), safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"), safe(tn, tn + fp).alias("specificity"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n, share of the true class) over the full grid of labels of either column."""
    t = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    labels = t.select(F.col("truth").alias("l")).union(t.select("pred")).distinct()
    grid = labels.select(F.col("l").alias("truth")).join(labels.select(F.col("l").alias("pred")))  # labels x labels, few
    full = grid.join(t, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.withColumn("share", or_zero(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("truth")))))


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """precision, recall, f1, support of every label: one-against-the-rest sums of the confusion table."""
    c = confusion(df, truth, pred)
    rows = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    safe = lambda a, b: or_zero(F.try_divide(a.cast("double"), b.cast("double")))
    return rows.join(cols, "label").select(
        "label", F.col("support").cast("long").alias("support"), safe(F.col("tp"), F.col("predicted")).alias("precision"),
        safe(F.col("tp"), F.col("support")).alias("recall"), safe(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def weighted_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, and precision, recall and f1 weighted by support."""
    by = per_class(df, truth, pred)
    total = F.sum("support")
    parts = [(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("precision", "recall", "f1")]
    return by.agg((F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), *parts, total.cast("long").alias("n"))


def roc_auc(df: DataFrame, truth: str | Column, score: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; null for a single class.

    Scores are first counted by distinct value, so the ordered pass is over values,
    not rows; ties count half.
    """
    values = df.groupBy(*by, _col(score).alias("_s")).agg(F.count_if(_col(truth)).alias("_p"), F.count_if(~_col(truth)).alias("_n"))
    rows = running_sums(values, "_s", {"_b": "_n"}, by, before=True)
    area = F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2)) / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))
    return rows.groupBy(*by).agg(area.alias("auc"), F.sum("_p").cast("long").alias("positives"), F.sum("_n").cast("long").alias("negatives"))


def roc_points(df: DataFrame, truth: str | Column, score: str | Column) -> DataFrame:
    """(threshold, tpr, fpr): a point for each distinct score, the highest first."""
    values = df.groupBy(_col(score).alias("threshold")).agg(F.count_if(_col(truth)).alias("_p"), F.count_if(~_col(truth)).alias("_n"))
    rows = running_sums(values, "threshold", {"_tp": "_p", "_fp": "_n"}, descending=True)
    share = lambda c: F.col(c) / F.nullif(F.col(f"{c}_total"), F.lit(0))
    return rows.select("threshold", share("_tp").alias("tpr"), share("_fp").alias("fpr"))


def one_vs_rest_auc(df: DataFrame, truth: str, probabilities: str, classes: int) -> DataFrame:
    """(auc, n): areas of each class against the rest, weighted by its rows; a class without rows, or that all rows have, takes no part."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(probabilities)[i].alias("p")) for i in range(classes))))
    rows = df.select(F.col(truth).alias("_t"), each.alias("x")).select(F.col("x.c").alias("class"), (F.col("_t") == F.col("x.c")).alias("_y"), F.col("x.p").alias("_p"))
    by = roc_auc(rows, "_y", "_p", ["class"]).filter("auc is not null")
    return by.agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("auc"), F.sum("positives").alias("n"))


def brier(truth: str | Column, p: str | Column) -> Column:
    return F.avg(F.pow(_col(p) - _col(truth).cast("double"), 2))


def log_loss(truth: str | Column, p: str | Column, clip: float = 1e-15) -> Column:
    q = F.least(F.greatest(_col(p), F.lit(clip)), F.lit(1 - clip))
    return -F.avg(F.when(_col(truth).cast("int") == 1, F.log(q)).otherwise(F.log(1 - q)))


def calibration_bins(df: DataFrame, truth: str | Column, p: str | Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, observed, centre): equal bins, open above but the last. Edges are the literal k * (1 / bins) values."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    q = _col(p)
    number = F.lit(-1)
    for e in edges[:-1]:
        number = number + (q >= e).cast("int")
    number = F.when(q > 1, None).otherwise(F.least(number, F.lit(bins - 1)))
    rows = df.select(number.alias("bin"), q.alias("_q"), _col(truth).cast("double").alias("_t")).filter(F.col("bin") >= 0)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_q").alias("confidence"), F.avg("_t").alias("observed")).withColumn("centre", (F.col("bin") + 0.5) / float(bins))


def calibration_error(df: DataFrame, truth: str | Column, p: str | Column, bins: int = 10) -> DataFrame:
    """Expected calibration error: |confidence - observed| weighted by the bins' rows."""
    return calibration_bins(df, truth, p, bins).agg((F.sum(F.abs(F.col("confidence") - F.col("observed")) * F.col("n")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def threshold_sweep(df: DataFrame, truth: str | Column, score: str | Column, cutoffs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """binary_metrics at every cutoff. Rows are first counted by which cutoffs they pass, so the sweep multiplies a handful of counts, not rows."""
    s = _col(score)
    passed = sum(((s >= c).cast("int") for c in sorted(cutoffs)), F.lit(0))
    small = df.groupBy(*by, passed.alias("_k"), _col(truth).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(sorted(cutoffs)))))
    rows = small.withColumn("_c", at).withColumn("_pred", F.col("_k") > F.col("_c.i")).withColumn("cutoff", F.col("_c.c"))
    sums = {k: F.sum(F.when(c, F.col("_n")).otherwise(0)).cast("long") for k, c in
            {"tp": F.col("_t") & F.col("_pred"), "fp": ~F.col("_t") & F.col("_pred"), "tn": ~F.col("_t") & ~F.col("_pred"), "fn": F.col("_t") & ~F.col("_pred")}.items()}
    out = rows.groupBy(*by, "cutoff").agg(*(c.alias(k) for k, c in sums.items()))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    safe = lambda a, b: or_zero(F.try_divide(a.cast("double"), b.cast("double")))
    return out.select("*", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def score_summary(df: DataFrame, value: str | Column, by: Sequence[str] = (), sample: bool = False) -> DataFrame:
    """n, mean, std, median, q25, q75, min, max; the deviation of the rows, or of a sample of more."""
    v = _col(value)
    std = F.stddev_samp(v) if sample else F.stddev_pop(v)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), std.alias("std"), q.alias("_q"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(*by, "n", "mean", "std", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), "min", "max")


def box_summary(df: DataFrame, value: str | Column, by: Sequence[str]) -> DataFrame:
    """q25, median, q75 and whiskers: the outermost values within 1.5 interquartile ranges."""
    v = _col(value)
    quart = df.filter(v.isNotNull()).groupBy(*by).agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = df.select(*by, v.alias("_v")).join(quart, list(by)).filter((F.col("_v") >= F.col("q")[0] - reach) & (F.col("_v") <= F.col("q")[2] + reach))
    return inside.groupBy(*by).agg(F.first("q")[0].alias("q25"), F.first("q")[1].alias("median"), F.first("q")[2].alias("q75"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def histogram(df: DataFrame, value: str | Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins, the last closed above; values outside are left out."""
    v = _col(value)
    number = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.filter((v >= low) & (v <= high)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, value: str | Column) -> DataFrame:
    """(value, n, share of rows up to it): a row for each distinct value."""
    by = df.groupBy(_col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(by, "value", {"_sum": "n"}).select("value", "n", (F.col("_sum") / F.col("_sum_total")).alias("share"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings, from their contingency table."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.withColumn("ra", F.sum("n").over(Window.partitionBy("a"))).withColumn("rb", F.sum("n").over(Window.partitionBy("b")))
    two = lambda c: c * (c - 1) / 2
    n, na, nb = F.col("n"), F.col("ra"), F.col("rb")
    sums = rows.agg(
        F.sum(n).alias("t"), F.sum(two(n)).alias("both"), F.sum(n / na * two(na)).alias("sa"), F.sum(n / nb * two(nb)).alias("sb"),
        F.sum(n * F.log(n)).alias("hn"), F.sum(n * F.log(na)).alias("ha"), F.sum(n * F.log(nb)).alias("hb"),
    )
    t, sa, sb = F.col("t"), F.col("sa"), F.col("sb")
    expected = sa * sb / two(t)
    ent_a, ent_b = F.log(t) - F.col("ha") / t, F.log(t) - F.col("hb") / t
    mutual = (F.col("hn") - F.col("ha") - F.col("hb")) / t + F.log(t)
    return sums.select(
        F.coalesce(F.try_divide(F.col("both") - expected, (sa + sb) / 2 - expected), F.lit(1.0)).alias("ari"),
        F.coalesce(F.try_divide(mutual, (ent_a + ent_b) / 2), F.lit(1.0)).alias("nmi"),
    )

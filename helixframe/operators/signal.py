"""Operators on ordered positions of a sequence: smoothing, lags, peaks, periods.

Each works on (sequence, position, value) rows, positions numbers that are distinct in
a sequence. Frames are taken in blocks of places with copied edges (`tracks`), peaks are
merged and spectra computed in blocks (`peaks`, `spectrum`), totals come from a row a
block: a sequence of any length is spread over many tasks.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .ordered import running_sums
from .peaks import kept_peaks
from .spectrum import dominant_period as dominant_period  # one of this module's operators
from .tracks import WIDTH, framed, numbered, over, own


def moving_average_zero(df: DataFrame, seq: str, pos: str, value: str, width: int, out: str = "smooth", block: int = WIDTH) -> DataFrame:
    """Centred mean; positions beyond the ends count 0, so it divides by the full width."""
    left, right = width // 2, (width - 1) // 2
    rows = framed(numbered(df, seq, pos, width=block), left, right, width=block)
    return own(rows.withColumn(out, F.sum(value).over(over(seq).rowsBetween(-left, right)) / float(width)))


def moving_average_reflect(df: DataFrame, seq: str, pos: str, value: str, width: int, out: str = "smooth", block: int = WIDTH) -> DataFrame:
    """Centred mean (an even width leans left); beyond the ends the values are mirrored, the end value repeated."""
    left, right = width // 2, (width - 1) // 2
    rows = framed(numbered(df, seq, pos, width=block), left, right, reflect=True, width=block)
    return own(rows.withColumn(out, F.sum(F.col(value).cast("double")).over(over(seq).rowsBetween(-left, right)) / float(width)))


def lag_autocorrelation(df: DataFrame, seq: str, pos: str, value: str, lags: tuple[int, ...] = (1, 3), unbiased: bool = False, block: int = WIDTH) -> DataFrame:
    """A row for each sequence: lag<k>, the sum of products of centred values over that at lag 0; unbiased: the mean product over the variance."""
    rows = numbered(df.select(seq, pos, F.col(value).alias("_x")), seq, pos, "_x", block)
    rows = framed(rows.withColumn("c", F.col("_x") - F.col("_mean")), 0, max(lags), width=block)
    for k in lags:
        rows = rows.withColumn(f"p{k}", F.col("c") * F.lead("c", k).over(over(seq)))
    agg = F.avg if unbiased else F.sum
    return rows.filter("_own").groupBy(seq).agg(*(F.try_divide(agg(f"p{k}"), agg(F.col("c") * F.col("c"))).alias(f"lag{k}") for k in lags))


def offset_cosine(df: DataFrame, seq: str, pos: str, vector: str, offsets: tuple[int, ...] = (1, 3), block: int = WIDTH) -> DataFrame:
    """A row for each sequence: cos<k>, the mean cosine of vectors k positions apart. A zero vector has similarity 0."""
    v = vec.as_double(vector)
    rows = framed(numbered(df.select(seq, pos, v.alias("v"), vec.norm(v).alias("n")), seq, pos, width=block), 0, max(offsets), width=block)
    for k in offsets:
        far, fn = F.lead("v", k).over(over(seq)), F.lead("n", k).over(over(seq))
        rows = rows.withColumn(f"v{k}", far).withColumn(f"n{k}", fn)
    safe = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    cos = {k: F.when(F.col(f"v{k}").isNotNull(), vec.dot("v", f"v{k}") / (safe("n") * safe(f"n{k}"))) for k in offsets}
    return rows.filter("_own").groupBy(seq).agg(*(F.avg(c).alias(f"cos{k}") for k, c in cos.items()))


def offset_comb(df: DataFrame, seq: str, pos: str, vector: str, offsets: range = range(1, 16), group: str | None = None, block: int = WIDTH) -> DataFrame:
    """Mean and standard error of the cosine at every offset, by group of sequences."""
    v = vec.as_double(vector)
    keys = [group] if group else []
    rows = framed(numbered(df.select(seq, *keys, pos, v.alias("v"), vec.norm(v).alias("n")), seq, pos, width=block), 0, max(offsets), width=block)
    order = over(seq)
    ahead = F.array(*(F.struct(F.lit(k).alias("k"), F.lead("v", k).over(order).alias("v"), F.lead("n", k).over(order).alias("n")) for k in offsets))
    pairs = rows.withColumn("ahead", ahead).filter("_own").withColumn("far", F.explode("ahead")).drop("ahead").filter("far.v is not null and n > 0 and far.n > 0")
    cos = vec.dot("v", "far.v") / (F.col("n") * F.col("far.n"))
    by = pairs.groupBy(*keys, F.col("far.k").alias("offset"))
    return by.agg(F.avg(cos).alias("mean"), (F.stddev_pop(cos) / F.sqrt(F.count(cos))).alias("se"), F.count(cos).alias("n"))


def first_difference(df: DataFrame, seq: str, pos: str, value: str, out: str = "step", block: int = WIDTH) -> DataFrame:
    rows = framed(numbered(df, seq, pos, width=block), 0, 1, width=block)
    return own(rows.withColumn(out, F.abs(F.lead(value).over(over(seq)) - F.col(value))))


def local_peaks(df: DataFrame, seq: str, pos: str, value: str, sds: float = 1.5, block: int = WIDTH) -> DataFrame:
    """Rows above both neighbours and above the mean plus so many standard deviations; ends are no peaks."""
    rows = framed(numbered(df, seq, pos, value, block), 1, 1, width=block)
    v, order = F.col(value), over(seq)
    marked = rows.withColumn("_peak", (v > F.lag(value).over(order)) & (v > F.lead(value).over(order)) & (v > F.col("_mean") + sds * F.col("_sd")))
    return own(marked).filter("_peak").drop("_peak")


def high_points(df: DataFrame, seq: str, value: str, sds: float = 2.0) -> DataFrame:
    """Rows above the sequence's mean plus so many standard deviations."""
    limits = df.groupBy(F.col(seq).alias("_seq")).agg((F.avg(value) + sds * F.stddev_pop(value)).alias("_lim"))
    return df.join(limits, F.col(seq).eqNullSafe(F.col("_seq"))).filter(F.col(value) > F.col("_lim")).drop("_seq", "_lim")


def merge_peaks(peaks: DataFrame, seq: str, pos: str, value: str, within: int = 30) -> DataFrame:
    """One array of kept peaks a sequence: in order, a peak closer than `within` to the last kept one replaces it if higher, else goes."""
    return kept_peaks(peaks, seq, pos, value, within).groupBy(seq).agg(F.array_sort(F.collect_list(pos)).alias("peaks"))


def power_at(df: DataFrame, seq: str, pos: str, value: str, period: int = 3) -> DataFrame:
    """Power of the centred values at one period and its share of the whole spectrum without the constant, by sequence; all built in."""
    rows = numbered(df.select(seq, pos, F.col(value).alias("_x")), seq, pos, "_x").select(seq, (F.col("_x") - F.col("_mean")).alias("c"), F.col("_i").alias("i"))
    angle = F.col("i") * (2 * pi / period)
    power = F.pow(F.sum(F.col("c") * F.cos(angle)), 2) + F.pow(F.sum(F.col("c") * F.sin(angle)), 2)
    # the squares of all frequencies add up to n times the squared values
    return rows.groupBy(seq).agg(power.alias("power"), F.try_divide(2 * power, F.count(F.lit(1)) * F.sum(F.col("c") * F.col("c"))).alias("share"))


def norm_stats(df: DataFrame, seq: str, vector: str) -> DataFrame:
    """Mean, standard deviation and coefficient of variation of vector lengths, by sequence."""
    n = vec.norm(vec.as_double(vector))
    by = df.select(seq, n.alias("n")).groupBy(seq)
    return by.agg(F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"), (F.stddev_pop("n") / F.greatest(F.avg("n"), F.lit(0.001))).alias("norm_cv"))


def medians(df: DataFrame, seq: str, value: str) -> DataFrame:
    """(sequence, median) without a sequence's values in one place: values are counted, and the middle ones found by running counts over ranges."""
    by = df.filter(F.col(value).isNotNull()).groupBy(seq, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_one"))
    at = running_sums(by, "_x", {"_at": "_one"}, by=(seq,), before=True)
    low, high = F.floor((F.col("_at_total") - 1) / 2), F.floor(F.col("_at_total") / 2)  # places from 0 of the two middle values
    holds = lambda place: (F.col("_at") <= place) & (place < F.col("_at") + F.col("_one"))
    return at.filter(holds(low) | holds(high)).groupBy(seq).agg(((F.min("_x") + F.max("_x")) / 2).alias("median"))


def above_median(df: DataFrame, seq: str, value: str, mask: str) -> DataFrame:
    """Share of values above the sequence's median, and how often that agrees with a 0/1 mask, either way round."""
    middle = medians(df, seq, value).toDF("_seq", "_m")
    pred = (F.col(value) > F.col("_m")).cast("int")
    by = df.join(middle, F.col(seq) == F.col("_seq")).groupBy(seq)
    agree = F.avg((pred == F.col(mask)).cast("double"))
    return by.agg(F.avg(pred.cast("double")).alias("coding_fraction"), agree.alias("accuracy"), F.greatest(agree, 1 - agree).alias("best_accuracy"))


def window_shift(df: DataFrame, seq: str, pos: str, vector: str, width: int = 100, step: int = 50) -> DataFrame:
    """Cosine distances of the mean vectors of neighbouring windows: uniformity (1 - their deviation) and the largest, by sequence."""
    v = vec.as_double(vector)
    rows = numbered(df.select(seq, pos, v.alias("v")), seq, pos).select(seq, F.col("_i").alias("i"), F.col("_n").alias("n"), "v")
    first, last = F.greatest(F.ceil((F.col("i") - width + 1) / step), F.lit(0)), F.floor(F.col("i") / step)
    inside = rows.withColumn("w", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).filter(F.col("w") * step < F.col("n") - width)
    dims = inside.select(seq, "w", F.posexplode("v").alias("d", "x")).groupBy(seq, "w", "d").agg(F.avg("x").alias("x"))
    means = dims.groupBy(seq, "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("m"))
    pairs = means.withColumn("next", F.lead("m").over(Window.partitionBy(seq).orderBy("w"))).filter("next is not null")
    return pairs.select(seq, (1 - vec.cosine("m", "next")).alias("d")).groupBy(seq).agg((1 - F.stddev_pop("d")).alias("uniformity"), F.max("d").alias("max_shift"))


def frame_variance(df: DataFrame, seq: str, pos: str, value: str, width: int, block: int = WIDTH) -> DataFrame:
    """Variance of the values in a trailing frame, from running sums."""
    rows = framed(numbered(df, seq, pos, width=block), width - 1, 0, width=block)
    frame = over(seq).rowsBetween(-(width - 1), 0)
    return own(rows.withColumn("frame_var", F.avg(F.col(value) * F.col(value)).over(frame) - F.pow(F.avg(value).over(frame), 2)))

"""Queries on ordered positions: vectors by id are positions of sequences of a hundred; labels below 5 are coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import signal as S
from ..operators.peaks import kept_peaks
from .registry import query, six, table

_P = """SELECT vec_id // 100 AS seq, vec_id AS pos, CAST(label < 5 AS INT) AS coding, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"""
_X = f"""p AS ({_P}), x AS (SELECT *, v[1] AS x, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY seq) AS n FROM p)"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.floor(F.col("vec_id") / 100).alias("seq"), F.col("vec_id").alias("pos"), (F.col("label") < 5).cast("int").alias("coding"), "embedding", F.col("embedding")[0].cast("double").alias("x"))


@query(f"""WITH p AS ({_P}), q AS (SELECT seq, v, lead(v, 1) OVER w AS v1, lead(v, 3) OVER w AS v3 FROM p WINDOW w AS (PARTITION BY seq ORDER BY pos))
    SELECT seq, round(avg(list_cosine_similarity(v, v1)), 6) AS cos1, round(avg(list_cosine_similarity(v, v3)), 6) AS cos3 FROM q GROUP BY seq""")
def offset_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.offset_cosine(_positions(spark, sf_dir), "seq", "pos", "embedding").select("seq", six("cos1").alias("cos1"), six("cos3").alias("cos3"))


@query(f"""WITH p AS ({_P}), q AS (SELECT coding, pos, seq, v FROM p), r AS (SELECT a.seq, a.v AS v, b.v AS w, k FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pos) AS i FROM q) a,
    range(1, 16) t(k) JOIN (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pos) AS i FROM q) b ON a.seq = b.seq AND b.i = a.i + k)
    SELECT CAST(k AS INTEGER) AS "offset", round(avg(list_cosine_similarity(v, w)), 6) AS mean, round(stddev_pop(list_cosine_similarity(v, w)) / sqrt(count(*)), 6) AS se, count(*) AS n FROM r GROUP BY k""")
def offset_comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.offset_comb(_positions(spark, sf_dir), "seq", "pos", "embedding").select("offset", six("mean").alias("mean"), six("se").alias("se"), "n")


@query(f"""WITH {_X}, c AS (SELECT seq, pos, x - avg(x) OVER (PARTITION BY seq) AS c FROM x), l AS (SELECT seq, c, c * lead(c, 1) OVER w AS p1, c * lead(c, 3) OVER w AS p3 FROM c WINDOW w AS (PARTITION BY seq ORDER BY pos))
    SELECT seq, round(sum(p1) / sum(c * c), 6) AS lag1, round(sum(p3) / sum(c * c), 6) AS lag3, round(avg(p1) / avg(c * c), 6) AS mean_lag1, round(avg(p3) / avg(c * c), 6) AS mean_lag3 FROM l GROUP BY seq""")
def lag_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _positions(spark, sf_dir)
    a = S.lag_autocorrelation(rows, "seq", "pos", "x")
    b = S.lag_autocorrelation(rows, "seq", "pos", "x", unbiased=True)
    return a.join(b.toDF("seq", "m1", "m3"), "seq").select("seq", six("lag1").alias("lag1"), six("lag3").alias("lag3"), six("m1").alias("mean_lag1"), six("m3").alias("mean_lag3"))


@query(f"WITH {_X} SELECT seq, pos, round(sum(x) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) + 0.0 AS smooth FROM x")
def moving_average_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.moving_average_zero(_positions(spark, sf_dir), "seq", "pos", "x", 5).select("seq", "pos", six("smooth").alias("smooth"))


@query(f"""WITH {_X}, o AS (SELECT a.seq, a.pos, CASE WHEN a.i + d < 0 THEN -(a.i + d) - 1 WHEN a.i + d >= a.n THEN 2 * a.n - 1 - (a.i + d) ELSE a.i + d END AS j FROM x a, range(-3, 3) t(d))
    SELECT o.seq, o.pos, round(avg(b.x), 6) + 0.0 AS smooth FROM o JOIN x b ON b.seq = o.seq AND b.i = o.j GROUP BY ALL""")
def moving_average_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.moving_average_reflect(_positions(spark, sf_dir), "seq", "pos", "x", 6).select("seq", "pos", six("smooth").alias("smooth"))


_PEAKS = f"""{_X}, k AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b, avg(x) OVER (PARTITION BY seq) + 1.0 * stddev_pop(x) OVER (PARTITION BY seq) AS lim FROM x WINDOW w AS (PARTITION BY seq ORDER BY pos)),
    peaks AS (SELECT seq, pos, x FROM k WHERE x > a AND x > b AND x > lim)"""


@query(f"WITH {_PEAKS} SELECT seq, pos, round(x, 6) AS x FROM peaks")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.local_peaks(_positions(spark, sf_dir), "seq", "pos", "x", 1.0).select("seq", "pos", six("x").alias("x"))


@query(f"""WITH RECURSIVE {_PEAKS}, n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pos) AS k FROM peaks),
    f(seq, k, kept, last_x) AS (SELECT seq, 1, [pos], x FROM n WHERE k = 1 UNION ALL
        SELECT n.seq, CAST(n.k AS INT), CASE WHEN n.pos - f.kept[-1] < 12 THEN CASE WHEN n.x > f.last_x THEN list_append(f.kept[:-2], n.pos) ELSE f.kept END ELSE list_append(f.kept, n.pos) END,
               CASE WHEN n.pos - f.kept[-1] < 12 AND n.x <= f.last_x THEN f.last_x ELSE n.x END FROM f JOIN n ON n.seq = f.seq AND n.k = f.k + 1),
    z AS (SELECT seq, kept, row_number() OVER (PARTITION BY seq ORDER BY k DESC) AS r FROM f)
    SELECT seq, unnest(kept) AS pos FROM z WHERE r = 1""")
def greedy_peak_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = S.local_peaks(_positions(spark, sf_dir), "seq", "pos", "x", 1.0)
    return S.merge_peaks(peaks, "seq", "pos", "x", 12).select("seq", F.explode("peaks").alias("pos"))


@query(f"WITH p AS ({_P}), n AS (SELECT seq, sqrt(list_dot_product(v, v)) AS n FROM p) SELECT seq, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round(stddev_pop(n) / greatest(avg(n), 0.001), 6) AS norm_cv FROM n GROUP BY seq")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.norm_stats(_positions(spark, sf_dir), "seq", "embedding").select("seq", *(six(c).alias(c) for c in ("norm_mean", "norm_std", "norm_cv")))


@query(f"""WITH {_X}, m AS (SELECT seq, median(x) AS m FROM x GROUP BY seq), q AS (SELECT seq, CAST(x > m AS INT) AS p, coding FROM x JOIN m USING (seq))
    SELECT seq, round(avg(p), 6) AS coding_fraction, round(avg(CAST(p = coding AS INT)), 6) AS accuracy, round(greatest(avg(CAST(p = coding AS INT)), 1 - avg(CAST(p = coding AS INT))), 6) AS best_accuracy FROM q GROUP BY seq""")
def coding_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.above_median(_positions(spark, sf_dir), "seq", "x", "coding").select("seq", *(six(c).alias(c) for c in ("coding_fraction", "accuracy", "best_accuracy")))


@query(f"""WITH {_X}, c AS (SELECT seq, i, n, x - avg(x) OVER (PARTITION BY seq) AS c FROM x)
    SELECT seq, round(pow(sum(c * cos(i * 2 * pi() / 3)), 2) + pow(sum(c * sin(i * 2 * pi() / 3)), 2), 6) AS power,
           round(2 * (pow(sum(c * cos(i * 2 * pi() / 3)), 2) + pow(sum(c * sin(i * 2 * pi() / 3)), 2)) / (count(*) * sum(c * c)), 6) AS share FROM c GROUP BY seq""")
def third_frequency_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.power_at(_positions(spark, sf_dir), "seq", "pos", "x", 3).select("seq", six("power").alias("power"), six("share").alias("share"))


@query(f"""WITH {_X}, c AS (SELECT seq, i, n, x - avg(x) OVER (PARTITION BY seq) AS c FROM x),
    f AS (SELECT seq, k, max(n) AS n, round(pow(sum(c * cos(2 * pi() * i * k / n)), 2) + pow(sum(c * sin(2 * pi() * i * k / n)), 2), 9) AS p FROM c, range(1, 51) t(k) WHERE k <= n // 2 GROUP BY seq, k),
    b AS (SELECT seq, n / arg_max(k, p) AS period, max(n) AS n FROM f GROUP BY seq, n),
    t AS (SELECT seq, k, p, row_number() OVER (PARTITION BY seq ORDER BY abs(k / n - 1.0 / 3), k) AS r FROM f)
    SELECT b.seq, round(b.period, 6) AS period, CAST((SELECT count(*) FROM f WHERE f.seq = b.seq AND f.p > t.p) + 1 AS INTEGER) AS third_rank FROM b JOIN t ON t.seq = b.seq AND t.r = 1""")
def fft_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dominant_period(_positions(spark, sf_dir), "seq", "pos", "x").select("seq", six("period").alias("period"), "third_rank")


@query(f"WITH {_X}, d AS (SELECT seq, pos, abs(lead(x) OVER (PARTITION BY seq ORDER BY pos) - x) AS step FROM x) SELECT seq, count(step) AS n, round(max(step), 6) AS largest, round(avg(step), 6) AS mean FROM d GROUP BY seq")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.first_difference(_positions(spark, sf_dir), "seq", "pos", "x")
    return d.groupBy("seq").agg(F.count("step").alias("n"), six(F.max("step")).alias("largest"), six(F.avg("step")).alias("mean"))


@query(f"""WITH {_X}, w AS (SELECT a.seq, k, b.v FROM x b JOIN (SELECT DISTINCT seq, n FROM x) a ON a.seq = b.seq, range(0, 20) t(k) WHERE k * 10 < a.n - 20 AND b.i >= k * 10 AND b.i < k * 10 + 20),
    dims AS (SELECT seq, k, d, avg(v[d]) AS x FROM w, range(1, 65) t(d) GROUP BY ALL), m AS (SELECT seq, k, list(x ORDER BY d) AS m FROM dims GROUP BY seq, k),
    s AS (SELECT seq, 1 - list_cosine_similarity(m, lead(m) OVER (PARTITION BY seq ORDER BY k)) AS d FROM m)
    SELECT seq, round(1 - stddev_pop(d), 6) AS uniformity, round(max(d), 6) AS max_shift FROM s WHERE d IS NOT NULL GROUP BY seq""")
def window_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_shift(_positions(spark, sf_dir), "seq", "pos", "embedding", 20, 10).select("seq", six("uniformity").alias("uniformity"), six("max_shift").alias("max_shift"))


@query(f"""WITH p AS ({_P}), d AS (SELECT seq, d, avg(v[d]) AS x FROM p, range(1, 65) t(d) GROUP BY ALL), m AS (SELECT seq, list(x ORDER BY d) AS m FROM d GROUP BY seq)
    SELECT seq, len(m) AS size, round(sqrt(list_dot_product(m, m)), 6) AS norm FROM m""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.neighbours import mean_pool as pool

    return pool(_positions(spark, sf_dir), "seq", "embedding").select("seq", F.size("vector").cast("long").alias("size"), six(vec.norm("vector")).alias("norm"))


_EVENTS = "v AS (SELECT event_type AS seq, event_id AS pos, value AS x FROM events WHERE value IS NOT NULL)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long sequences: the values of each type of event in the order of their ids."""
    return table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_type").alias("seq"), F.col("event_id").alias("pos"), F.col("value").alias("x"))


@query(f"WITH {_EVENTS} SELECT seq, pos, round(sum(x) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING) / 100.0, 6) AS smooth FROM v")
def long_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.moving_average_zero(_events(spark, sf_dir), "seq", "pos", "x", 100, block=1 << 10).select("seq", "pos", six("smooth").alias("smooth"))


@query(f"""WITH {_EVENTS}, k AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b, avg(x) OVER (PARTITION BY seq) + 0.5 * stddev_pop(x) OVER (PARTITION BY seq) AS lim FROM v WINDOW w AS (PARTITION BY seq ORDER BY pos)),
    peaks AS (SELECT seq, pos, x FROM k WHERE x > a AND x > b AND x > lim), g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY seq ORDER BY pos) AS gap FROM peaks),
    i AS (SELECT *, sum(CAST(coalesce(gap, 30) >= 30 AS INT)) OVER (PARTITION BY seq ORDER BY pos) AS island FROM g), o AS (SELECT seq, island, list(pos ORDER BY pos) AS p, list(x ORDER BY pos) AS v FROM i GROUP BY seq, island),
    f AS (SELECT seq, list_reduce(list_transform(range(1, len(p) + 1), lambda j: [[p[j], v[j]]]),
                 lambda a, b: CASE WHEN b[1][1] - a[-1][1] < 30 THEN CASE WHEN b[1][2] > a[-1][2] THEN list_concat(a[:-2], b) ELSE a END ELSE list_concat(a, b) END) AS kept FROM o)
    SELECT seq, CAST(u[1] AS BIGINT) AS pos FROM (SELECT seq, unnest(kept) AS u FROM f)""")
def long_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_peaks(S.local_peaks(_events(spark, sf_dir), "seq", "pos", "x", 0.5), "seq", "pos", "x", 30, width=1 << 8)


@query(f"""WITH {_EVENTS}, x AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY seq) AS n, x - avg(x) OVER (PARTITION BY seq) AS c FROM v),
    f AS (SELECT seq, k, max(n) AS n, round(pow(sum(c * cos(2 * pi() * ((i * k) % n) / n)), 2) + pow(sum(c * sin(2 * pi() * ((i * k) % n) / n)), 2), 6) AS p FROM x, range(1, 200000) t(k) WHERE k <= n // 2 GROUP BY seq, k),
    b AS (SELECT seq, max(n) / arg_max(k, p) AS period FROM f GROUP BY seq), t AS (SELECT seq, k, p, row_number() OVER (PARTITION BY seq ORDER BY abs(k / n - 1.0 / 3), k) AS r FROM f)
    SELECT b.seq, round(b.period, 6) AS period, CAST((SELECT count(*) FROM f WHERE f.seq = b.seq AND f.p > t.p) + 1 AS INTEGER) AS third_rank FROM b JOIN t ON t.seq = b.seq AND t.r = 1""")
def long_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dominant_period(_events(spark, sf_dir), "seq", "pos", "x", short=1 << 8, tile=8).select("seq", six("period").alias("period"), "third_rank")

"""Queries that evaluate predictions: a text's quality label is the truth, a score made of its length the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import metrics as M
from ..operators import sampling as S
from .registry import query, six, table

_S = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality = 1 AS good, l.toxic = 1 AS toxic, (d.n_chars % 997) / 997.0 AS s0, d.n_chars / (d.n_chars + 800.0) AS score
    FROM documents d JOIN labels l USING (doc_id)"""
_BIN = "CASE WHEN n_chars >= 500 AND n_chars < 1000 THEN '500-1000' WHEN n_chars >= 1000 AND n_chars < 3000 THEN '1000-3000' WHEN n_chars >= 3000 AND n_chars < 5000 THEN '3000-5000' WHEN n_chars >= 5000 AND n_chars < 10000 THEN '5000-10000' WHEN n_chars >= 10000 AND n_chars < 16000 THEN '10000-16000' ELSE 'other' END"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    n = F.col("n_chars").cast("double")
    return d.join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), (F.pmod("n_chars", F.lit(997)) / 997.0).alias("s0"), (n / (n + 800.0)).alias("score"))


def _sixes(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six(c) for c in columns})


_PRED = "CASE WHEN n_chars % 7 = 0 THEN 'en' ELSE lang END"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.when(F.pmod("n_chars", F.lit(7)) == 0, "en").otherwise(F.col("lang")).alias("pred"))


_CONF = f"""p AS (SELECT lang AS truth, {_PRED} AS pred, count(*) AS n FROM documents GROUP BY ALL), l AS (SELECT truth AS l FROM p UNION SELECT pred FROM p),
    g AS (SELECT a.l AS truth, b.l AS pred, coalesce(p.n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.truth = a.l AND p.pred = b.l)"""


@query(f"WITH {_CONF} SELECT truth, pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) AS share FROM g")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.confusion(_predicted(spark, sf_dir), "lang", "pred"), "share")


_PRF = f"""{_CONF}, r AS (SELECT truth AS label, sum(n) AS support, sum(n) FILTER (truth = pred) AS tp FROM g GROUP BY truth), c AS (SELECT pred AS label, sum(n) AS predicted FROM g GROUP BY pred),
    m AS (SELECT label, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM r JOIN c USING (label))"""


@query(f"WITH {_PRF} SELECT label, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def prf_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.per_class(_predicted(spark, sf_dir), "lang", "pred"), "precision", "recall", "f1")


@query(f"""WITH {_PRF} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
    round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS n FROM m""")
def weighted_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.weighted_metrics(_predicted(spark, sf_dir), "lang", "pred"), "accuracy", "precision", "recall", "f1")


_BM = """round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def _binary_sql(by: str) -> str:
    return f"""WITH s AS ({_S}), c AS (SELECT {by}, count(*) FILTER (good AND score >= 0.5) AS tp, count(*) FILTER (NOT good AND score >= 0.5) AS fp, count(*) FILTER (NOT good AND score < 0.5) AS tn,
        count(*) FILTER (good AND score < 0.5) AS fn FROM s GROUP BY ALL) SELECT *, tp + fp + tn + fn AS n, {_BM} FROM c"""


@query(_binary_sql("lang"))
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.binary_metrics(_scored(spark, sf_dir), "good", F.col("score") >= 0.5, ["lang"]), "accuracy", "precision", "recall", "specificity", "f1")


@query(f"""WITH s AS ({_S}), r AS (SELECT good, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
    SELECT round((sum(r) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)), 6) AS auc,
           count(*) FILTER (good) AS positives, count(*) FILTER (NOT good) AS negatives FROM r""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.roc_auc(_scored(spark, sf_dir), "good", "score"), "auc")


@query(f"WITH s AS ({_S}) SELECT round(avg(pow(score - CAST(good AS INT), 2)), 6) AS brier, round(-avg(CASE WHEN good THEN ln(score) ELSE ln(1 - score) END), 6) AS log_loss FROM s")
def brier_and_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(six(M.brier(F.col("good").cast("int"), "score")).alias("brier"), six(M.log_loss(F.col("good"), "score")).alias("log_loss"))


_CAL = f"s AS ({_S}), b AS (SELECT least(CAST(floor(s0 * 10) AS INT), 9) AS bin, count(*) AS n, avg(s0) AS confidence, avg(CAST(good AS INT)) AS observed FROM s GROUP BY 1)"


@query(f"WITH {_CAL} SELECT bin, n, round(confidence, 6) AS confidence, round(observed, 6) AS observed, round((bin + 0.5) / 10, 6) AS centre FROM b")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.calibration_bins(_scored(spark, sf_dir), "good", "s0"), "confidence", "observed", "centre")


@query(f"WITH {_CAL} SELECT round(sum(abs(confidence - observed) * n) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.calibration_error(_scored(spark, sf_dir), "good", "s0"), "ece")


@query(f"""WITH s AS ({_S}), c AS (SELECT c AS cutoff, count(*) FILTER (good AND score >= c) AS tp, count(*) FILTER (NOT good AND score >= c) AS fp, count(*) FILTER (NOT good AND score < c) AS tn, count(*) FILTER (good AND score < c) AS fn
        FROM s, (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) t(c) GROUP BY c)
    SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.threshold_sweep(_scored(spark, sf_dir), "good", "score", [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), "precision", "recall", "f1")


@query(f"""WITH s AS ({_S}), v AS (SELECT score, count(*) FILTER (good) AS p, count(*) FILTER (NOT good) AS n FROM s GROUP BY score)
    SELECT score AS threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM v WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.roc_points(_scored(spark, sf_dir), "good", "score"), "tpr", "fpr")


@query(f"WITH s AS ({_S}), v AS (SELECT n_chars AS value, count(*) AS n FROM s GROUP BY 1) SELECT value, n, round(sum(n) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS share FROM v")
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.ecdf(_scored(spark, sf_dir), "n_chars"), "share")


@query(f"WITH s AS ({_S}) SELECT least(CAST(floor(score * 50) AS INT), 49) AS bin, count(*) AS n FROM s WHERE score BETWEEN 0 AND 1 GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram(_scored(spark, sf_dir), "score", 0.0, 1.0, 50)


@query(f"""SELECT lang, {_BIN} AS length_bin, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, median(n_chars) AS median, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.75) AS q75,
    min(n_chars) AS min, max(n_chars) AS max FROM documents GROUP BY ALL""")
def length_bin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", rules.length_bin("n_chars").alias("length_bin"))
    return _sixes(M.score_summary(d, "n_chars", ["lang", "length_bin"]), "mean", "std")


@query(f"WITH s AS ({_S}) SELECT lang, {_BIN} AS length_bin, round(avg(score), 6) AS score_mean, round(avg(s0), 6) AS s0_mean, round(stddev_samp(score), 6) AS score_std, round(stddev_samp(s0), 6) AS s0_std, count(*) AS n FROM s GROUP BY ALL")
def stats_by_category_and_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("length_bin", rules.length_bin("n_chars"))
    return s.groupBy("lang", "length_bin").agg(six(F.avg("score")).alias("score_mean"), six(F.avg("s0")).alias("s0_mean"), six(F.stddev_samp("score")).alias("score_std"), six(F.stddev_samp("s0")).alias("s0_std"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS ({_S}), q AS (SELECT lang, quantile_cont(score, 0.25) AS a, median(score) AS m, quantile_cont(score, 0.75) AS b FROM s GROUP BY lang)
    SELECT s.lang, round(any_value(a), 6) AS q25, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q75, round(min(score), 6) AS low, round(max(score), 6) AS high FROM s JOIN q ON s.lang = q.lang WHERE score >= a - 1.5 * (b - a) AND score <= b + 1.5 * (b - a) GROUP BY s.lang""")
def box_plot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.box_summary(_scored(spark, sf_dir), "score", ["lang"]), "q25", "median", "q75", "low", "high")


@query(f"WITH s AS ({_S}) SELECT lang, count(*) AS n, count(*) FILTER (score >= 0.9) AS high, count(*) FILTER (score >= 0.5 AND score < 0.9) AS middle, count(*) FILTER (score < 0.5) AS low, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(min(score), 6) AS min, round(max(score), 6) AS max FROM s GROUP BY lang")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    return _scored(spark, sf_dir).groupBy("lang").agg(F.count(s).alias("n"), F.count_if(s >= 0.9).alias("high"), F.count_if((s >= 0.5) & (s < 0.9)).alias("middle"), F.count_if(s < 0.5).alias("low"), six(F.avg(s)).alias("mean"), six(F.median(s)).alias("median"), six(F.min(s)).alias("min"), six(F.max(s)).alias("max"))


@query(f"""WITH s AS ({_S}) SELECT lang, {_BIN} AS length_bin, round(avg(CAST(score >= 0.5 AS INT)) * 100, 6) AS rate, count(*) AS n FROM s WHERE good GROUP BY GROUPING SETS ((lang, length_bin), (lang), ())""")
def detection_rate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).filter("good").withColumn("length_bin", rules.length_bin("n_chars"))
    return s.rollup("lang", "length_bin").agg(six(F.avg((F.col("score") >= 0.5).cast("double")) * 100).alias("rate"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS ({_S}) SELECT count(*) FILTER ((score >= 0.5) = good AND (s0 >= 0.5) <> good) AS a_only, count(*) FILTER ((score >= 0.5) <> good AND (s0 >= 0.5) = good) AS b_only,
    count(*) FILTER ((score >= 0.5) = good AND (s0 >= 0.5) = good) AS both, count(*) FILTER ((score >= 0.5) <> good AND (s0 >= 0.5) <> good) AS neither, round(corr(score, s0), 6) AS correlation,
    count(*) FILTER (score > s0) AS wins, count(*) FILTER (score = s0) AS ties, count(*) FILTER (score < s0) AS losses FROM s""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("a", (F.col("score") >= 0.5) == F.col("good")).withColumn("b", (F.col("s0") >= 0.5) == F.col("good"))
    a, b = F.col("a"), F.col("b")
    return s.agg(F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), six(F.corr("score", "s0")).alias("correlation"),
                 F.count_if(F.col("score") > F.col("s0")).alias("wins"), F.count_if(F.col("score") == F.col("s0")).alias("ties"), F.count_if(F.col("score") < F.col("s0")).alias("losses"))


@query(f"""WITH c AS (SELECT lang AS a, source AS b, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c),
    x AS (SELECT max(t) AS t, sum(n * (n - 1) / 2) AS nn, sum(n * (ra - 1) / 2) AS sa, sum(n * (rb - 1) / 2) AS sb, sum(n / t * ln(n * t / (ra * rb))) AS mi, -sum(n / t * ln(ra / t)) AS ha, -sum(n / t * ln(rb / t)) AS hb FROM r)
    SELECT round((nn - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) + 0.0 AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM x""")
def cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(M.adjusted_rand(table(spark, sf_dir, "documents"), "lang", "source"), "ari", "nmi")


@query(f"""WITH s AS ({_S}), t AS (SELECT avg(CAST((score >= 0.5) = good AS INT)) AS accuracy, count(*) AS n, count(*) FILTER (toxic) / count(*) AS toxic_share FROM s)
    SELECT 'accuracy' AS check_name, round(accuracy, 6) AS value, CASE WHEN accuracy >= 0.9 THEN 'PASS' WHEN accuracy >= 0.6 THEN 'WARN' ELSE 'FAIL' END AS status FROM t
    UNION ALL SELECT 'rows', round(n, 6), CASE WHEN n >= 300 THEN 'PASS' WHEN n >= 100 THEN 'WARN' ELSE 'FAIL' END FROM t
    UNION ALL SELECT 'toxic_share', round(toxic_share, 6), CASE WHEN toxic_share <= 0.05 THEN 'PASS' WHEN toxic_share <= 0.2 THEN 'WARN' ELSE 'FAIL' END FROM t""")
def check_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    t = s.agg(F.avg(((F.col("score") >= 0.5) == F.col("good")).cast("double")).alias("accuracy"), F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("toxic").cast("double")).alias("toxic_share"))
    up = lambda c, a, b: F.when(F.col(c) >= a, "PASS").when(F.col(c) >= b, "WARN").otherwise("FAIL")
    down = F.when(F.col("toxic_share") <= 0.05, "PASS").when(F.col("toxic_share") <= 0.2, "WARN").otherwise("FAIL")
    rows = [("accuracy", "accuracy", up("accuracy", 0.9, 0.6)), ("rows", "n", up("n", 300, 100)), ("toxic_share", "toxic_share", down)]
    return t.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), six(c).alias("value"), st.alias("status")) for n, c, st in rows))))


_ORDER = "(doc_id * 2654435761 + 42) % 4294967291, doc_id"


@query(f"""WITH b AS (SELECT doc_id, {_BIN} AS length_bin FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY length_bin ORDER BY {_ORDER}) AS r FROM b), n AS (SELECT length_bin, count(*) AS n, row_number() OVER (ORDER BY length_bin) - 1 AS k, count(*) OVER () AS m FROM b GROUP BY 1),
    s AS (SELECT length_bin, n, 200 // m + CAST(k < 200 % m AS INT) AS share FROM n), f AS (SELECT r.* FROM r JOIN s USING (length_bin) WHERE r <= share), g AS (SELECT r.* FROM r JOIN s USING (length_bin) WHERE r > share ORDER BY {_ORDER} LIMIT (SELECT 200 - sum(least(n, share)) FROM s))
    SELECT doc_id, length_bin FROM f UNION ALL SELECT doc_id, length_bin FROM g""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", rules.length_bin("n_chars").alias("length_bin"))
    return S.stratified(d, "length_bin", 200, "doc_id")


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS r FROM documents), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
    SELECT doc_id, lang FROM r, m WHERE r <= m""")
def balance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.balance(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, CASE WHEN r > round(n * 0.2) THEN 'train' WHEN r % 2 = 1 THEN 'calibration' ELSE 'test' END AS part, CAST((r - 1) % 5 AS INTEGER) AS fold FROM r""")
def split_and_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.folds(S.split(d, "lang", "doc_id"), "lang", "doc_id").select("doc_id", "part", "fold")


@query(f"WITH s AS ({_S}) SELECT doc_id, round(abs(score - 0.5), 6) AS margin FROM s ORDER BY abs(score - 0.5), doc_id LIMIT 20")
def topk_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.abs(F.col("score") - 0.5).alias("m")).orderBy("m", "doc_id").limit(20).select("doc_id", six("m").alias("margin"))


@query(f"""WITH s AS ({_S}) SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'viral' WHEN score <= 0.3 THEN 'non_viral' ELSE 'borderline' END AS triage, CASE WHEN score > 0.8 THEN 1 WHEN score < 0.2 THEN 0 ELSE -1 END AS pseudo_label FROM s""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", six("score").alias("score"), rules.triage("score").alias("triage"), F.coalesce(rules.pseudo_label("score"), F.lit(-1)).alias("pseudo_label"))

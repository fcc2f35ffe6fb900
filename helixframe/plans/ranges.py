"""Queries on intervals: an event is an interval of ten minutes of its user, on the axis of seconds; texts are sequences to tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from .registry import query, six, table

_EV = "SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 600 AS \"end\", value FROM events"
_ISL = """i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}))"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + 600).alias("end"), "value")


@query(f"""WITH e AS ({_EV}), h AS (SELECT * FROM e WHERE value >= 20), {_ISL.format(gap=86400, src='h')},
    m AS (SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n_windows, avg(value) AS mean_score, max(value) AS max_score FROM i GROUP BY user_id, island)
    SELECT user_id, start, "end", "end" - start AS length, n_windows, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, CAST(row_number() OVER (ORDER BY user_id, start) - 1 AS INTEGER) AS region_no
    FROM m WHERE "end" - start >= 601""")
def gap_merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = I.merge_regions(_events(spark, sf_dir), "user_id", "value", 20, 86400, 601)
    return r.select("user_id", "start", "end", "length", "n_windows", six("mean_score").alias("mean_score"), six("max_score").alias("max_score"), "region_no")


@query(f"""WITH e AS ({_EV}), h AS (SELECT user_id, greatest(start - 7200, 0) AS start, least("end" + 7200, 1800000000) AS "end" FROM e WHERE value >= 30), {_ISL.format(gap=0, src='h')}
    SELECT user_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY user_id, island""")
def candidate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("len", F.lit(1800000000).cast("long"))
    return I.candidate_regions(rows, "user_id", "len", "value", 30, 7200).select("user_id", "start", "end")


_TILE = """SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0"""
_STARTS = """SELECT DISTINCT {key}, s AS start, least(s + {size}, {n}) AS "end" FROM (SELECT *, unnest(list_append(range(0, greatest({n} - {size}, 0) + 1, {step}), greatest({n} - {size}, 0))) AS s FROM {src})"""


@query(f"""WITH d AS ({_TILE}), w AS ({_STARTS.format(key='doc_id', size=500, step=200, n='n', src='d')})
    SELECT doc_id, start, "end", doc_id || ':' || start || ':' || "end" AS window_id FROM w""")
def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return I.tile(docs, "doc_id", "n", 500, 200).select("doc_id", "start", "end", "window_id")


@query(f"WITH d AS ({_TILE}) SELECT doc_id, CAST(greatest(1, floor((n - 500) / 200) + 1) AS BIGINT) AS windows FROM d")
def estimated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).filter("n > 0")
    return docs.select("doc_id", I.count_windows("n", 500, 200).alias("windows"))


@query(f"""WITH d AS ({_TILE}), r AS (SELECT doc_id, n, greatest(n // 4 - 100, 0) AS a, least(n // 2 + 300, n) AS b FROM d JOIN labels USING (doc_id) WHERE quality = 1),
    w AS (SELECT DISTINCT doc_id, a + s AS start, least(a + s + 300, b, n) AS "end" FROM (SELECT *, unnest(list_append(range(0, greatest(b - a - 300, 0) + 1, 100), greatest(b - a - 300, 0))) AS s FROM r))
    SELECT doc_id, start, "end", doc_id || ':' || start || ':' || "end" AS window_id FROM w""")
def region_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")).filter("n > 0")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    regions = lengths.join(good, "doc_id").select("doc_id", F.greatest(F.expr("n div 4") - 100, F.lit(0)).alias("start"), F.least(F.expr("n div 2") + 300, F.col("n")).alias("end"))
    return I.tile_regions(regions, lengths, "doc_id", "n", 300, 100).select("doc_id", "start", "end", "window_id")


@query(f"""WITH d AS ({_TILE}) SELECT doc_id, greatest((n // 3 + n // 2) // 2 - 250, 0) AS start, least((n // 3 + n // 2) // 2 + 250, n) AS "end" FROM d
    WHERE least((n // 3 + n // 2) // 2 + 250, n) - greatest((n // 3 + n // 2) // 2 - 250, 0) >= 100""")
def orf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")).filter("n > 0")
    start, end = I.centred_window(F.expr("n div 3"), F.expr("n div 2"), "n", 500)
    return d.select("doc_id", start.alias("start"), end.alias("end")).filter("end - start >= 100")


@query(f"""WITH e AS ({_EV}), f AS (SELECT * FROM e WHERE event_type <> 'purchase'), m AS (SELECT * FROM e WHERE event_type = 'purchase'),
    o AS (SELECT f.event_id, sum(least(f."end", m."end") - greatest(f.start, m.start)) AS cov FROM f JOIN m ON f.user_id = m.user_id AND f.start < m."end" AND m.start < f."end" GROUP BY 1)
    SELECT event_id, round(coalesce(cov, 0) / 600, 6) AS masked_share, coalesce(cov, 0) / 600 >= 0.5 AS rejected FROM f LEFT JOIN o USING (event_id)""")
def mask_overlap_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    out = I.reject_masked(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'"), "user_id", "event_id")
    return out.select("event_id", six("masked_share").alias("masked_share"), "rejected")


@query(f"""WITH e AS ({_EV}), x AS (SELECT user_id, start AS x FROM e UNION SELECT user_id, "end" FROM e), r AS (SELECT user_id, x AS a, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS b FROM x)
    SELECT r.user_id, a AS start, b AS "end", count(*) AS n, round(avg(value), 6) AS mean FROM r JOIN e ON e.user_id = r.user_id AND e.start <= a AND e."end" >= b WHERE b IS NOT NULL GROUP BY ALL""")
def coverage_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = I.coverage_mean(_events(spark, sf_dir), "user_id", "value")
    return runs.select("user_id", "start", "end", F.col("n").cast("long").alias("n"), six("mean").alias("mean"))


@query(f"""WITH e AS ({_EV}), p AS (SELECT DISTINCT user_id, start AS pos FROM e WHERE event_type = 'purchase'), o AS (SELECT DISTINCT user_id, start AS other FROM e WHERE event_type = 'click'),
    d AS (SELECT p.user_id, pos, other, abs(pos - other) AS distance, row_number() OVER (PARTITION BY p.user_id, pos ORDER BY abs(pos - other), other) AS k FROM p JOIN o USING (user_id))
    SELECT user_id, pos, other, distance FROM d WHERE k = 1""")
def nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    at = e.filter("event_type = 'purchase'").select("user_id", F.col("start").alias("pos")).distinct()
    other = e.filter("event_type = 'click'").select("user_id", F.col("start").alias("other")).distinct()
    return I.nearest_other(at, other, "user_id", "pos", "other")


@query(f"""WITH e AS ({_EV}), p AS (SELECT DISTINCT user_id, start AS pos FROM e WHERE event_type = 'purchase'), o AS (SELECT DISTINCT user_id, start AS other FROM e WHERE event_type = 'click')
    SELECT p.user_id, pos, other, abs(pos - other) AS distance FROM p JOIN o ON p.user_id = o.user_id AND abs(pos - other) <= 43200""")
def near_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    at = e.filter("event_type = 'purchase'").select("user_id", F.col("start").alias("pos")).distinct()
    other = e.filter("event_type = 'click'").select("user_id", F.col("start").alias("other")).distinct()
    return I.near_join(at, other, "user_id", "pos", "other", 43200)


@query(f"""WITH e AS ({_EV}), m AS (SELECT user_id, start - 86400 AS a, start + 86400 AS b FROM e WHERE event_type = 'purchase')
    SELECT e.user_id, e.start AS pos, CAST(count(m.a) > 0 AS INTEGER) AS covered FROM e LEFT JOIN m ON m.user_id = e.user_id AND m.a <= e.start AND e.start < m.b GROUP BY e.event_id, e.user_id, e.start""")
def position_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    spans = e.filter("event_type = 'purchase'").select("user_id", (F.col("start") - 86400).alias("start"), (F.col("start") + 86400).alias("end"))
    return I.position_mask(e.select("user_id", F.col("start").alias("pos")), spans, "user_id")


@query(f"""WITH e AS ({_EV}), g AS (SELECT user_id, lag("end") OVER (PARTITION BY user_id ORDER BY start, "end") AS a, start AS b FROM e)
    SELECT user_id, coalesce(a, 0) AS gap_start, b AS gap_end, b - coalesce(a, 0) AS size FROM g WHERE b - coalesce(a, 0) > CASE WHEN a IS NULL THEN 50 ELSE 20 END""")
def intergenic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.gaps_between(_events(spark, sf_dir), "user_id")


@query("""SELECT user_id, w AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM
    (SELECT user_id, value, unnest([b, b - 43200]) AS w, s FROM (SELECT user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) // 43200 * 43200 AS b FROM events)) WHERE s >= w AND s < w + 86400 GROUP BY ALL""")
def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import hopping

    return hopping(table(spark, sf_dir, "events")).select("user_id", "window_start", "n", six("total").alias("total"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 86400000000 THEN 0 ELSE 1 END AS f FROM e),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, CAST(floor(min(t) / 1000000) AS BIGINT) AS session_start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "1 day").select("user_id", "session_start", "n", six("total").alias("total"))

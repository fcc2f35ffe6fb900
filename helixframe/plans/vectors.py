"""Queries on the table of vectors: labels are categories, label 0 is noise where clusters are meant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, vec
from ..operators import neighbours as N
from .registry import query, six, table

#: Categories of the labels 0 to 4.
CATEGORIES = {0: "chromosome", 1: "plasmid", 2: "phage", 3: "rna_virus", 4: "cellular"}
_E = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_CENTROIDS = f"""e AS ({_E}),
    dims AS (SELECT label, d, avg(v[d]) AS x FROM e, range(1, 65) t(d) GROUP BY label, d),
    c AS (SELECT label, list(x ORDER BY d) AS centroid FROM dims GROUP BY label)"""
_SIMS = f"""{_CENTROIDS},
    s AS (SELECT e.vec_id, c.label, coalesce(list_cosine_similarity(e.v, c.centroid), 0) AS sim FROM e, c)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return N.centroid_similarities(df, "vec_id", "embedding", N.centroids(df, "label", "embedding"))


@query(f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS k FROM s)
    SELECT vec_id, CAST(label AS VARCHAR) AS nearest, round(sim, 6) AS similarity FROM r WHERE k = 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nearest_label(_similarities(spark, sf_dir), "vec_id").withColumn("similarity", six("similarity"))


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = _similarities(spark, sf_dir)
    names = F.create_map(*(F.lit(x) for k, v in CATEGORIES.items() for x in (str(k), v)))
    named = F.transform_keys(F.map_filter("similarities", lambda k, v: k.cast("int") < 5), lambda k, v: names[k])
    scores = rules.origin_scores(named)
    return sims.select("vec_id", *(c.alias(k) for k, c in scores.items()))


_ORIGINS = f"""{_SIMS},
    m AS (SELECT vec_id, max(sim) FILTER (label = 0) AS chromosome, max(sim) FILTER (label = 1) AS plasmid, max(sim) FILTER (label = 2) AS phage,
                 max(sim) FILTER (label = 3) AS rna, max(sim) FILTER (label = 4) AS cellular FROM s GROUP BY vec_id),
    o AS (SELECT vec_id, greatest(phage, rna) / greatest(chromosome, cellular, 0.001) AS viral_signature,
                 rna / greatest(phage, 0.001) AS rna_origin_score, (phage + plasmid) / (2 * greatest(chromosome, 0.001)) AS mobile_element_score FROM m)"""


@query(f"WITH {_ORIGINS} SELECT vec_id, round(viral_signature, 6) AS viral_signature, round(rna_origin_score, 6) AS rna_origin_score, round(mobile_element_score, 6) AS mobile_element_score FROM o")
def origin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _origins(spark, sf_dir).select("vec_id", *(six(c).alias(c) for c in ("viral_signature", "rna_origin_score", "mobile_element_score")))


@query(f"""WITH {_ORIGINS} SELECT vec_id,
    CASE WHEN viral_signature > 1.3 THEN 'likely viral' WHEN viral_signature > 1.0 THEN 'possibly viral' WHEN viral_signature > 0.7 THEN 'ambiguous' ELSE 'likely non-viral' END AS viral,
    CASE WHEN rna_origin_score > 1.1 THEN 'RNA-origin' WHEN rna_origin_score > 0.9 THEN 'ambiguous origin' ELSE 'DNA-origin' END AS origin,
    CASE WHEN mobile_element_score > 1.2 THEN 'mobile element' WHEN mobile_element_score > 0.8 THEN 'possibly mobile' ELSE 'chromosomal' END AS mobility FROM o""")
def interpretation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _origins(spark, sf_dir)
    return o.select("vec_id", rules.viral_ladder("viral_signature").alias("viral"), rules.origin_ladder("rna_origin_score").alias("origin"), rules.mobility_ladder("mobile_element_score").alias("mobility"))


_NEAR = f"""e AS ({_E}), p AS (SELECT * FROM e WHERE label < 5),
    d AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.v, p.v) AS d FROM e a, p),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d),
    a AS (SELECT vec_id, max(d) AS anomaly FROM r WHERE k <= 10 GROUP BY vec_id)"""


@query(f"WITH {_NEAR} SELECT vec_id, round(anomaly, 6) AS anomaly FROM a")
def knn_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return N.anomaly_scores(df, df.filter("label < 5"), 10).select(F.col("query_id").alias("vec_id"), six("anomaly").alias("anomaly"))


@query(f"""WITH {_NEAR}, x AS (SELECT a.vec_id, round(a.anomaly, 9) AS anomaly, e.label FROM a JOIN e USING (vec_id))
    SELECT q.vec_id, round((SELECT count(*) FROM x p WHERE p.label < 5 AND p.anomaly < q.anomaly) / (SELECT count(*) FROM x p WHERE p.label < 5), 6) AS percentile FROM x q""")
def anomaly_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    scores = N.anomaly_scores(df, df.filter("label < 5"), 10).select(F.col("query_id").alias("vec_id"), F.round("anomaly", 9).alias("anomaly"))
    scored = scores.join(df.select("vec_id", "label"), "vec_id")
    reference = scored.filter("label < 5").select(F.col("anomaly").alias("ref"))
    return N.strict_percentile(scored, reference, "anomaly", "ref").select("vec_id", six("percentile").alias("percentile"))


@query(f"""WITH e AS ({_E}), d AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.v, b.v), 12), b.vec_id) AS k
                FROM e a JOIN e b ON a.vec_id <> b.vec_id)
    SELECT label, count(*) AS n, round(avg(CAST(label = other AS INT)), 6) AS accuracy FROM d WHERE k = 1 GROUP BY label""")
def nn_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    near = N.knn(df, df, 1, skip_self=True)
    own = df.select(F.col("vec_id").alias("query_id"), "label")
    other = df.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("other"))
    return near.join(own, "query_id").join(other, "neighbour_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), six(F.avg((F.col("label") == F.col("other")).cast("double"))).alias("accuracy"))


_PAIRS = f"""e AS ({_E}), p AS (SELECT least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b, list_cosine_similarity(a.v, b.v) AS s
    FROM e a JOIN e b ON a.vec_id < b.vec_id)"""


@query(f"WITH {_PAIRS} SELECT label_a = label_b AS same, count(*) AS n_pairs, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM p GROUP BY ALL")
def pairwise_within_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = N.cross_similarity(_vectors(spark, sf_dir), "label", "embedding").withColumn("same", F.col("label_a") == F.col("label_b"))
    return N.similarity_stats(pairs, ["same"]).select("same", "n_pairs", six("mean").alias("mean"), six("std").alias("std"))


@query(f"WITH {_PAIRS} SELECT label_a, label_b, count(*) AS n_pairs, round(avg(s), 6) AS mean FROM p GROUP BY ALL")
def category_cross_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = N.cross_similarity(_vectors(spark, sf_dir), "label", "embedding", squares=False)
    return N.similarity_stats(pairs, ["label_a", "label_b"]).select("label_a", "label_b", "n_pairs", six("mean").alias("mean"))


def _silhouette_sql(distance: str) -> str:
    return f"""WITH e AS ({_E}), d AS (SELECT a.vec_id, a.label, b.label AS other, avg({distance}) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
    s AS (SELECT vec_id, label, max(d) FILTER (label = other) AS i, min(d) FILTER (label <> other) AS o FROM d GROUP BY ALL)
    SELECT vec_id, label, round(coalesce((o - i) / greatest(i, o), 0), 6) AS silhouette FROM s"""


@query(_silhouette_sql("list_distance(a.v, b.v)"))
def silhouette_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.silhouette_euclidean(_vectors(spark, sf_dir), "vec_id", "label", "embedding").withColumn("silhouette", six("silhouette"))


@query(_silhouette_sql("1 - list_cosine_similarity(a.v, b.v)"))
def silhouette_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.silhouette_cosine(_vectors(spark, sf_dir), "vec_id", "label", "embedding").withColumn("silhouette", six("silhouette"))


@query("""WITH s AS (SELECT label - 1 AS c, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT count(*) FILTER (c >= 0) AS n_clusters, CAST(coalesce(sum(n) FILTER (c < 0), 0) AS BIGINT) AS n_noise, round(avg(n) FILTER (c >= 0), 6) AS mean_size,
           median(n) FILTER (c >= 0) AS median_size, max(n) FILTER (c >= 0) AS largest, min(n) FILTER (c >= 0) AS smallest FROM s""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.cluster_summary(_vectors(spark, sf_dir).withColumn("cluster", F.col("label") - 1), "cluster")
    return out.withColumn("mean_size", six("mean_size"))


@query(f"""WITH e0 AS ({_E}), e AS (SELECT vec_id, label - 1 AS cluster, v FROM e0),
    dims AS (SELECT cluster, d, avg(v[d]) AS x FROM e, range(1, 65) t(d) WHERE cluster >= 0 GROUP BY ALL), c AS (SELECT cluster, list(x ORDER BY d) AS m FROM dims GROUP BY cluster),
    a AS (SELECT e.vec_id, e.cluster, CASE WHEN e.cluster < 0 THEN 0.0 ELSE list_distance(e.v, c.m) END AS d FROM e LEFT JOIN c USING (cluster))
    SELECT vec_id, cluster, round(d, 6) AS distance, cluster >= 0 AND row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id) = 1 AS is_representative FROM a""")
def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).withColumn("cluster", F.col("label") - 1)
    return N.assignments(df, "vec_id", "cluster", "embedding").withColumn("distance", six("distance"))


@query(f"WITH e AS ({_E}) SELECT vec_id, CAST(d AS INTEGER) AS d, round(v[d] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS x FROM e, range(1, 65) t(d)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(vec.unit(vec.as_double("embedding"))).alias("d", "x")).select("vec_id", (F.col("d") + 1).alias("d"), six("x").alias("x"))


@query(f"""WITH e AS ({_E}), x AS (SELECT vec_id, CAST(d AS INTEGER) AS d, v[d] AS x FROM e, range(1, 65) t(d)), s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY d)
    SELECT vec_id, d, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS x FROM x JOIN s USING (d)""")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.standard_scale(_vectors(spark, sf_dir), "vec_id", "embedding").select("vec_id", (F.col("d") + 1).alias("d"), six("x").alias("x"))


@query(f"""WITH e AS ({_E}), f AS (SELECT a.vec_id, list_concat(a.v, coalesce(b.v, list_transform(range(0, 64), lambda x: CAST(0 AS DOUBLE)))) AS v FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1 AND b.label = a.label)
    SELECT vec_id, len(v) AS size, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM f""")
def fuse_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).select("vec_id", "label", vec.as_double("embedding").alias("v"))
    other = df.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("v").alias("w"))
    fused = df.join(other, ["vec_id", "label"], "left").select("vec_id", vec.fuse("v", "w", 64).alias("v"))
    return fused.select("vec_id", F.size("v").cast("long").alias("size"), six(vec.norm("v")).alias("norm"))


@query("SELECT len(embedding) AS size, count(*) AS n, len(embedding) = 64 AS fits FROM embeddings GROUP BY ALL")
def dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy(F.size("embedding").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n")).withColumn("fits", F.col("size") == 64)


@query(f"""WITH e AS ({_E}), d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 10), b.vec_id) AS k
                FROM e a JOIN e b ON a.vec_id <> b.vec_id)
    SELECT src, dst, round(1 / (1 + d), 6) AS weight FROM d WHERE k <= 15 AND src < dst""")
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.neighbour_graph(_vectors(spark, sf_dir), 15).withColumn("weight", six("weight"))


@query(f"""WITH e AS ({_E}), n AS (SELECT label, sqrt(list_dot_product(v, v)) AS n, list_var_pop(v) AS var FROM e)
    SELECT label, count(*) AS n, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round(avg(var), 6) AS var_mean FROM n GROUP BY label""")
def norm_and_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vec.as_double("embedding")
    rows = _vectors(spark, sf_dir).select("label", v.alias("v")).select("label", vec.norm("v").alias("n"), vec.mean_of("v").alias("m"), "v")
    rows = rows.withColumn("var", vec.mean_of(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m")))))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), six(F.avg("n")).alias("norm_mean"), six(F.stddev_pop("n")).alias("norm_std"), six(F.avg("var")).alias("var_mean"))


@query(f"""WITH e AS ({_E}), p AS (SELECT vec_id, list_transform(v[1:4], lambda x: exp(4 * x)) AS w FROM e), q AS (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS p FROM p),
    s AS (SELECT vec_id, p[3] + p[4] AS score, p FROM q)
    SELECT vec_id, round(score, 6) AS viral_score, CASE WHEN score >= 0.6 THEN CASE WHEN p[3] >= p[4] THEN 'phage' ELSE 'rna_virus' END
           WHEN score <= 0.4 THEN CASE WHEN p[1] >= p[2] THEN 'chromosome' ELSE 'plasmid' END ELSE 'ambiguous' END AS classification FROM s""")
def class_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.slice(vec.as_double("embedding"), 1, 4), lambda x: F.exp(4 * x))
    rows = _vectors(spark, sf_dir).select("vec_id", v.alias("w"))
    rows = rows.select("vec_id", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda s, y: s + y)).alias("p"))
    classes = ["chromosome", "plasmid", "phage", "rna_virus"]
    return rows.select("vec_id", six(rules.viral_score("p", classes)).alias("viral_score"), rules.class_of("p", classes, 0.6).alias("classification"))

"""Queries that fit models on the vectors; their numbers have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import ml
from .registry import query, six, table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))


@query()
def pca_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.pca(_rows(spark, sf_dir), "embedding").select("vec_id", F.size("reduced").alias("components"), six(vec.norm("reduced")).alias("norm"))


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.kmeans(_rows(spark, sf_dir), "embedding", 10, starts=10).select("vec_id", "cluster")


@query()
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.density_clusters(_rows(spark, sf_dir), "vec_id", "embedding", 5)


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.neighbours import neighbour_graph

    return ml.communities(neighbour_graph(_rows(spark, sf_dir), 15), least=5)


@query()
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, held = ml.train_and_evaluate(_rows(spark, sf_dir), "vec_id", "embedding", "y", ["cellular", "viral"], kind="forest", trees=100, depth=5)
    return held.select("vec_id", "y", six(F.col("probabilities")[1]).alias("score"))


@query()
def network_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, held = ml.train_and_evaluate(_rows(spark, sf_dir), "vec_id", "embedding", "y", ["cellular", "viral"])
    return held.select("vec_id", "y", six(F.col("probabilities")[1]).alias("score"))


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return ml.bootstrap(rows, F.col("quality") == 1, F.col("n_chars") > 500, rounds=10_000)


@query("""WITH c AS (SELECT lang AS a, source AS b, count(*) AS k FROM documents GROUP BY 1, 2), r AS (SELECT a, CAST(sum(k) AS DOUBLE) AS x FROM c GROUP BY a), s AS (SELECT b, CAST(sum(k) AS DOUBLE) AS y FROM c GROUP BY b),
    n AS (SELECT CAST(sum(k) AS DOUBLE) AS n FROM c), m AS (SELECT sum(k / n * ln(n * k / (x * y))) AS m FROM c JOIN r ON r.a IS NOT DISTINCT FROM c.a JOIN s ON s.b IS NOT DISTINCT FROM c.b, n),
    e AS (SELECT sum(i / n * ln(n * i / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(x - i + 1) - lgamma(y - i + 1) - lgamma(n - x - y + i + 1))) AS e
          FROM r, s, n, range(1, 100000) t(i) WHERE i >= x + y - n AND i <= x AND i <= y),
    h AS (SELECT (SELECT -sum(x / n * ln(x / n)) FROM r, n) AS ha, (SELECT -sum(y / n * ln(y / n)) FROM s, n) AS hb)
    SELECT round((m - e) / ((ha + hb) / 2 - e), 6) AS ami FROM m, e, h""")
def adjusted_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.panels import adjusted_mutual_information as ami

    value = ami(table(spark, sf_dir, "documents"), "lang", "source")
    return spark.createDataFrame([(round(float(value), 6),)], "ami double")

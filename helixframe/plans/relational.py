"""Queries of joins, set operations and best hits on the tables of orders, parts, suppliers and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups as L
from .registry import query, six, table


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def labels_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.uncached(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return L.with_parents(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, CASE WHEN l.toxic = 1 THEN 'toxic' END, 'unannotated') AS annotation, coalesce(CAST(l.quality AS DOUBLE), 0.0) AS score FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    named = F.coalesce(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.lit("unannotated"))
    return j.select("doc_id", named.alias("annotation"), F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("score"))


@query("""WITH a AS (SELECT 'seq' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '_1' ELSE '' END AS dna FROM part), b AS (SELECT 'seq' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_1x' ELSE '' END AS protein, s_suppkey AS ord FROM supplier),
    e AS (SELECT dna, protein, 'exact' AS match, 0 AS o FROM a JOIN b ON dna = protein), m AS (SELECT dna FROM a WHERE dna NOT IN (SELECT protein FROM b)),
    p AS (SELECT dna, arg_min(protein, (ord, protein)) AS protein FROM m JOIN b ON (starts_with(dna, protein) AND length(protein) >= 4) OR (starts_with(protein, dna) AND length(dna) >= 4) GROUP BY dna)
    SELECT dna, protein, match FROM e UNION ALL SELECT m.dna, p.protein, CASE WHEN p.protein IS NULL THEN 'none' ELSE 'prefix' END FROM m LEFT JOIN p USING (dna)""")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    a = table(spark, sf_dir, "part").select(F.concat(F.lit("seq"), k.cast("string"), F.when(k % 3 == 0, "_1").otherwise("")).alias("dna"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("seq"), s.cast("string"), F.when(s % 2 == 0, "_1x").otherwise("")).alias("protein"), s.alias("ord"))
    return L.prefix_join(a, b, "dna", "protein", "ord").select("dna", "protein", "match")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return L.best_hit(hits, "l_partkey", "l_discount", "ord").drop("ord")


@query("SELECT source, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT 'customer' AS source, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part) GROUP BY source")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",)}
    both = L.tagged_union({t: table(spark, sf_dir, t).select(F.col(c[0]).cast("long").alias("k")) for t, c in parts.items()})
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("""WITH u AS (SELECT doc_id FROM documents), a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM documents WHERE n_chars > 1500)
    SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS "both", count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NULL) AS only_a, count(*) FILTER (a.doc_id IS NULL AND b.doc_id IS NOT NULL) AS only_b, count(*) FILTER (a.doc_id IS NULL AND b.doc_id IS NULL) AS neither
    FROM u LEFT JOIN a ON u.doc_id = a.doc_id LEFT JOIN b ON u.doc_id = b.doc_id""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return L.set_overlap(d.select("doc_id"), labels.filter("quality = 1").select("doc_id"), d.filter("n_chars > 1500").select("doc_id"), "doc_id")


@query("SELECT min(event_id) AS ord, user_id, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 6), event_id) AS value FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), "event_type", six("value").alias("value"))
    return L.last_wins(e, "user_id", "ord")


@query("SELECT vec_id, CASE WHEN label % 3 = 0 THEN -1 ELSE CAST(dense_rank() OVER (PARTITION BY label % 3 = 0 ORDER BY label) - 1 AS INTEGER) END AS cluster FROM embeddings")
def renumber_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, -1).otherwise(F.col("label") * 10).alias("cluster"))
    return L.renumber(e, "cluster").select("vec_id", "cluster")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), six(F.avg("l_quantity")).alias("mean_quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""WITH a AS (SELECT l_orderkey AS k, avg(l_quantity) / 50 AS s FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, (o_orderkey % 101) / 101.0 AS s, o_orderpriority AS p FROM orders)
    SELECT p AS priority, count(*) AS n, round(corr(a.s, b.s), 6) AS r, count(*) FILTER ((a.s >= 0.5) = (b.s >= 0.5)) AS agree, round(avg(a.s - b.s), 6) AS mean_gap FROM a JOIN b USING (k) GROUP BY p""")
def tier_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.avg("l_quantity") / 50).alias("a"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.pmod("o_orderkey", F.lit(101)) / 101.0).alias("b"), F.col("o_orderpriority").alias("priority"))
    return a.join(b, "k").groupBy("priority").agg(F.count(F.lit(1)).alias("n"), six(F.corr("a", "b")).alias("r"), F.count_if((F.col("a") >= 0.5) == (F.col("b") >= 0.5)).alias("agree"), six(F.avg(F.col("a") - F.col("b"))).alias("mean_gap"))


@query("SELECT event_type, n, first_id FROM (SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type) ORDER BY n DESC, first_id LIMIT 20")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    return by.orderBy(F.desc("n"), "first_id").limit(20)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def longest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (-F.col("l_quantity")).alias("_v"))
    return L.best_hit(li, "l_orderkey", "_v", "l_linenumber").drop("_v")

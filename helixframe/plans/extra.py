"""Queries of panels, tracks and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import panels as P
from .positions import _P, _positions
from .registry import query, six, table


@query("""WITH a AS (SELECT DISTINCT 'k' || (p_partkey % 37) AS a FROM part), b AS (SELECT s_suppkey AS o, 'xxk' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN 'yy' ELSE '' END AS b FROM supplier)
    SELECT a.a, arg_min(b.b, (b.o, b.b)) AS b FROM a LEFT JOIN b ON contains(a.a, b.b) OR contains(b.b, a.a) GROUP BY a.a""")
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), (F.col("p_partkey") % 37).cast("string")).alias("a")).distinct()
    k = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(k.alias("o"), F.concat(F.lit("xxk"), k.cast("string"), F.when(k % 2 == 0, "yy").otherwise("")).alias("b"))
    return P.contains_join(a, b, "a", "b", "o")


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'urgent' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'any' ELSE 'none' END AS source FROM customer""")
def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    urgent, every = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), o.select(F.col("o_custkey").alias("c_custkey"))
    return P.route(table(spark, sf_dir, "customer"), [("urgent", urgent), ("any", every)], "c_custkey")


@query("""WITH s AS (SELECT lang, doc_id, source || ' ' || (doc_id % 7) AS organism FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY lang, organism ORDER BY doc_id) AS k FROM s),
    c AS (SELECT lang, doc_id, organism, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM o WHERE k = 1) SELECT lang, doc_id, organism FROM c WHERE r <= 25""")
def ortholog_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat_ws(" ", "source", (F.col("doc_id") % 7).cast("string")).alias("organism"))
    return P.capped_panel(d, "lang", "organism", "doc_id", 25)


@query(f"""WITH p AS ({_P}), g AS (SELECT seq, seq * 100 + 20 AS a, seq * 100 + 60 AS b FROM (SELECT DISTINCT seq FROM p)), x AS (SELECT p.seq, p.pos, CAST(p.pos >= g.a AND p.pos < g.b AS INTEGER) AS coding,
    CAST(abs(p.pos - g.a) <= 5 OR abs(p.pos - g.b) <= 5 AS INTEGER) AS boundary FROM p JOIN g USING (seq)) SELECT seq, pos, coding, boundary, coding * (1 - boundary) AS interior FROM x""")
def boundary_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir)
    genes = p.select("seq").distinct().select("seq", (F.col("seq") * 100 + 20).alias("start"), (F.col("seq") * 100 + 60).alias("end"))
    return P.boundary_masks(p, genes, "seq", "pos", 5)


@query("""WITH f AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.label AS group_a, b.label AS group_b, count(*) AS n, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS mean FROM f a JOIN f b ON a.label < b.label OR (a.label = b.label AND a.vec_id < b.vec_id) GROUP BY ALL""")
def codon_group_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.group_distances(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean", six("mean"))


@query(f"""WITH p AS ({_P}), q AS (SELECT seq, pos, v, lead(v, 1) OVER w AS v1, lead(v, 3) OVER w AS v3 FROM p WINDOW w AS (PARTITION BY seq ORDER BY pos))
    SELECT seq, pos, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(coalesce(list_cosine_similarity(v, v1), 0), 6) + 0.0 AS cos1, round(coalesce(list_cosine_similarity(v, v3), 0), 6) + 0.0 AS cos3 FROM q""")
def offset_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.offset_tracks(_positions(spark, sf_dir), "seq", "pos", "embedding").select("seq", "pos", six("norm").alias("norm"), six("cos1").alias("cos1"), six("cos3").alias("cos3"))


@query("""SELECT source AS "group", count(*) FILTER (n_chars < 800) AS failures, count(*) AS n, round(count(*) FILTER (n_chars < 800) / count(*), 6) AS rate FROM documents GROUP BY source HAVING count(*) FILTER (n_chars < 800) > 0 ORDER BY failures DESC, source LIMIT 20""")
def failing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.failing_groups(table(spark, sf_dir, "documents"), "source", F.col("n_chars") < 800).withColumn("rate", six("rate"))


@query("SELECT c AS cutoff, count(*) FILTER (value >= c) AS n FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (25.0), (50.0)) t(c) GROUP BY c")
def cutoff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cutoff_counts(table(spark, sf_dir, "events"), "value", [1.0, 5.0, 10.0, 25.0, 50.0])


@query("""WITH f AS (SELECT l_suppkey AS item, l_linenumber AS setting, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY v DESC, setting) AS k FROM f)
    SELECT item, setting, round(v, 6) AS v FROM r WHERE k = 1""")
def best_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("setting")).agg(F.avg("l_quantity").alias("v"))
    return P.best_setting(f, "item", "setting", "v")[1].withColumn("v", six("v"))


@query("""SELECT CASE WHEN x < 0.02 THEN '<2%' WHEN x < 0.025 THEN '2%-2%' WHEN x < 0.03 THEN '2%-3%' ELSE '>=3%' END AS gc_bin, count(*) AS n, round(avg(CAST(n_chars > 1500 AS INT)) * 100, 6) AS rate FROM
    (SELECT n_chars, length(regexp_replace(text, '[^gc]', '', 'g')) / greatest(length(text), 1) AS x FROM documents) GROUP BY 1""")
def gc_bin_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import seq

    d = table(spark, sf_dir, "documents").select("n_chars", rules.gc_bin(seq.share_of("text", "gc"), (0.02, 0.025, 0.03)).alias("gc_bin"))
    return d.groupBy("gc_bin").agg(F.count(F.lit(1)).alias("n"), six(F.avg((F.col("n_chars") > 1500).cast("double")) * 100).alias("rate"))

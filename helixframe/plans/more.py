"""Queries of single expressions, evaluations and tilings that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, seq
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import panels as P
from ..operators import sampling
from ..operators import signal as S
from . import pipelines
from .positions import _X, _positions
from .registry import query, six, table


def _pick(names: list[str], k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (k % len(names) + 1).cast("int"))


@query("SELECT event_id, CASE WHEN value / 50 > 0.8 THEN 1 WHEN value / 50 < 0.2 THEN 0 END AS y FROM events WHERE value / 50 > 0.8 OR value / 50 < 0.2")
def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """only scores that are sure become labels."""
    return table(spark, sf_dir, "events").select("event_id", rules.pseudo_label(F.col("value") / 50).alias("y")).filter("y is not null")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS y FROM supplier WHERE s_suppkey % 4 <> 3")
def collapsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of cellular labels are one, others go."""
    label = _pick(["chromosome", "plasmid", "viral", "unknown"], F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", rules.collapse_label(label).alias("y")).filter("y is not null")


@query("SELECT doc_id, CASE WHEN n_chars >= 500 AND n_chars < 1500 THEN '500-1500' WHEN n_chars >= 1500 AND n_chars <= 3000 THEN '1500-3000' ELSE 'other' END AS closed, CASE WHEN n_chars >= 500 AND n_chars < 1500 THEN '500-1500' WHEN n_chars >= 1500 AND n_chars < 3000 THEN '1500-3000' ELSE 'other' END AS open FROM documents")
def length_bin_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last bin closed, or open, at its top."""
    bins = ((500, 1500), (1500, 3000))
    return table(spark, sf_dir, "documents").select("doc_id", rules.length_bin("n_chars", bins, True).alias("closed"), rules.length_bin("n_chars", bins).alias("open"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'Mammal' WHEN 1 THEN 'Fungus' ELSE 'Unknown' END AS domain FROM nation")
def mapped_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact lookup with a default."""
    return table(spark, sf_dir, "nation").select("n_nationkey", rules.mapped(F.col("n_regionkey").cast("string"), {"0": "Mammal", "1": "Fungus"}, "Unknown").alias("domain"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Virus ' || s_suppkey ELSE 'NC' END AS organism FROM supplier")
def organisms_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """after the last bar and before the comma, or before the first underscore."""
    k = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("id|x|Virus "), k, F.lit(", complete, genome"))).otherwise(F.concat(F.lit("NC_"), k, F.lit("_1")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", rules.top_organism(name).alias("organism"))


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND source = 'src0' AND n_chars / 4000 >= 0.8")
def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows complete in their key columns that are labelled cellular and score high."""
    d = table(spark, sf_dir, "documents").dropna(subset=["lang", "text"])
    return d.filter(rules.is_suspect(F.when(F.col("source") == "src0", "cellular").otherwise("viral"), F.col("n_chars") / 4000)).select("doc_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 = 0 ELSE s_suppkey % 5 <> 0 END AS coding FROM supplier")
def coding_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the flag, else the category's beginning."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", rules.is_coding(F.when(k % 3 == 0, k % 2 == 0), F.when(k % 5 == 0, "noncoding_rna").otherwise("coding")).alias("coding"))


@query("SELECT p_partkey, translate(p_name, 'Uu', 'Tt') AS dna, substr(p_name, 3, 5) AS slice, left(regexp_replace(p_name, '[^aeiou]', '', 'g'), 6) AS stripped, contains(lower(p_name), 'al') OR contains(lower(p_name), 'ro') AS named FROM part")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2, X5, X7, X17."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", seq.dna_of_rna("p_name").alias("dna"), seq.slice_of("p_name", F.lit(2), F.lit(7)).alias("slice"), seq.strip_to("p_name", "aeiou", 6).alias("stripped"), seq.contains_any("p_name", ["AL", "ro"]).alias("named"))


@query("SELECT doc_id, md5(text) AS same, strlen(text) AS n_bytes, CAST(list_sum(list_transform(range(1, strlen(text) + 1), lambda i: 1)) AS BIGINT) AS n_tokens FROM documents WHERE text <> ''")
def byte_tokens_and_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to base64 and back, and as bytes."""
    d = table(spark, sf_dir, "documents").filter("text <> ''")
    back = seq.decoded(F.base64(F.encode("text", "UTF-8")))
    return d.select("doc_id", F.md5(back).alias("same"), F.octet_length("text").cast("long").alias("n_bytes"), F.size(seq.byte_tokens("text")).cast("long").alias("n_tokens"))


@query("SELECT p_partkey, CAST(ascii(p_name) AS INTEGER) AS first, CAST(ascii(right(p_name, 1)) AS INTEGER) AS last FROM part")
def byte_tokens_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens themselves."""
    t = seq.byte_tokens("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(t, 1).alias("first"), F.element_at(t, -1).alias("last"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 32 AS INTEGER) END AS block, CASE WHEN s_suppkey % 4 = 0 THEN 'embedding' ELSE 'mlp.l3' END AS sublayer, CASE WHEN s_suppkey % 4 = 0 THEN 'embedding' ELSE 'blocks.' || (s_suppkey % 32) || '.mlp.l3' END AS native FROM supplier")
def layer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in parts, to the service's form and back."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "embedding").otherwise(F.concat(F.lit("blocks."), (k % 32).cast("string"), F.lit(".mlp.l3")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("n"))
    return rows.select("s_suppkey", seq.layer_parts("n").alias("p"), rules.layer_to_native(rules.layer_to_service("n")).alias("native")).select("s_suppkey", "p.block", "p.sublayer", "native")


@query("SELECT l_suppkey, round(avg(l_quantity) / (avg(l_discount) + 1e-10), 6) AS ratio FROM lineitem GROUP BY l_suppkey")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"))
    return by.select("l_suppkey", six(rules.cosine_ratio("a", "b")).alias("ratio"))


@query("SELECT doc_id, text IS NOT NULL AND text <> '' AND length(text) <= 40000 AS ok FROM documents WHERE length(text) BETWEEN 1 AND 40000")
def checked_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider takes; anything else would be an error that names the id."""
    d = table(spark, sf_dir, "documents").filter(F.length("text").between(1, 40_000))
    return d.select("doc_id", (F.length(seq.checked("text", "doc_id", 40_000)) > 0).alias("ok"))


_SHUFFLED = "((doc_id % 2147483648) * 2654435761 + 42) % 4294967291"


@query(f"SELECT doc_id FROM documents ORDER BY {_SHUFFLED}, doc_id LIMIT 50")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of fixed size by an arithmetic shuffle."""
    return sampling.sample_n(table(spark, sf_dir, "documents"), 50, "doc_id").select("doc_id")


@query("SELECT doc_id, size, CAST(count(*) AS BIGINT) AS copies FROM documents, (VALUES (200, 0), (200, 1), (800, 0)) t(size, c) WHERE length(text) >= size GROUP BY doc_id, size")
def fragment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of fixed sizes at hashed starts, each inside its text."""
    f = sampling.fragments(table(spark, sf_dir, "documents"), "doc_id", "text", table=((200, 2), (800, 1)), most_n=1.0)
    return f.filter(F.length("fragment") == F.col("size")).groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))


_TRUTH = "SELECT d.doc_id, l.quality = 1 AS t, least(d.n_chars / 3000, 1.0) AS s FROM documents d JOIN labels l USING (doc_id)"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.select("doc_id", (F.col("quality") == 1).alias("t"), F.least(F.col("n_chars") / 3000, F.lit(1.0)).alias("s"))


@query(f"""WITH r AS ({_TRUTH}), e AS (SELECT 'fn' AS kind, doc_id, s, s AS o FROM r WHERE t AND s < 0.5 UNION ALL SELECT 'fp', doc_id, s, -s FROM r WHERE NOT t AND s >= 0.5),
    k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o, doc_id) AS rank FROM e) SELECT kind, doc_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20""")
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty worst false negatives and positives."""
    return P.top_errors(_truth(spark, sf_dir), "doc_id", "t", "s").withColumn("score", six("score"))


@query("""WITH r AS (SELECT label % 3 AS y, [abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE), abs(embedding[3]::DOUBLE)] AS p FROM embeddings),
    a AS (SELECT c, sum(CASE WHEN x.y = c AND z.y <> c THEN CASE WHEN x.p[c + 1] > z.p[c + 1] THEN 1.0 WHEN x.p[c + 1] = z.p[c + 1] THEN 0.5 ELSE 0 END END) / sum(CASE WHEN x.y = c AND z.y <> c THEN 1.0 END) AS auc FROM r x, r z, range(3) t(c) GROUP BY c)
    SELECT round(sum(auc * n) / sum(n), 6) AS auc, CAST(sum(n) AS BIGINT) AS n FROM a JOIN (SELECT y, count(*) AS n FROM r GROUP BY y) ON c = y""")
def one_vs_rest_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of each class against the rest, weighted by its rows."""
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("y"), F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double"))).alias("p"))
    return M.one_vs_rest_auc(e, "y", "p", 3).select(six("auc").alias("auc"), "n")


@query(f"""WITH r AS (SELECT *, s >= 2 AS p FROM ({_TRUTH})) SELECT count(*) FILTER (t AND p) AS tp, CASE WHEN count(*) FILTER (p) = 0 THEN NULL ELSE count(*) FILTER (t AND p) / count(*) FILTER (p) END AS precision,
    count(*) FILTER (t AND p) / count(*) FILTER (t) AS recall FROM r""")
def undefined_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of nothing is null, not 0."""
    return M.binary_metrics(_truth(spark, sf_dir).withColumn("p", F.col("s") >= 2), "t", "p", undefined=None).select("tp", "precision", "recall")


@query("""WITH m AS (SELECT doc_id, lang, source <> 'src0' AS t FROM documents), c AS (SELECT 'a' AS tool, doc_id, n_chars > 1000 AS pred, n_chars / 4000 AS score FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'b', doc_id, n_chars > 2000, n_chars / 8000 FROM documents WHERE doc_id % 2 = 0)
    SELECT g.tool, m.lang, count(*) AS n, count(c.pred) AS evaluated, round(count(*) FILTER (m.t AND c.pred) / nullif(count(*) FILTER (m.t AND c.pred IS NOT NULL), 0), 6) AS sensitivity, round(avg(coalesce(c.score, 0)), 6) AS mean_score
    FROM m CROSS JOIN (VALUES ('a'), ('b')) g(tool) LEFT JOIN c ON c.tool = g.tool AND c.doc_id = m.doc_id GROUP BY g.tool, m.lang""")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity of what a tool evaluated; the mean score counts the rest as 0."""
    d = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    a = d.filter("doc_id % 3 <> 0").select(F.lit("a").alias("tool"), "doc_id", (n > 1000).alias("pred"), (n / 4000).alias("score"))
    b = d.filter("doc_id % 2 = 0").select(F.lit("b").alias("tool"), "doc_id", (n > 2000).alias("pred"), (n / 8000).alias("score"))
    out = P.category_scores(d.select("doc_id", "lang", (F.col("source") != "src0").alias("t")), a.unionByName(b), "doc_id", "lang", "t")
    return out.withColumns({"sensitivity": six("sensitivity"), "mean_score": six("mean_score")})


@query("""WITH c AS (SELECT doc_id, n_chars > 1000 AS p FROM documents WHERE doc_id % 3 <> 0), m AS (SELECT doc_id, source <> 'src0' AS t FROM documents), j AS (SELECT 'negative' AS missing, t, coalesce(p, false) AS p FROM m LEFT JOIN c USING (doc_id) UNION ALL SELECT 'skip', t, p FROM m JOIN c USING (doc_id))
    SELECT missing, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (t AND NOT p) AS fn FROM j GROUP BY missing""")
def missing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tool doesn't name is negative, or isn't counted."""
    d = table(spark, sf_dir, "documents")
    calls = {"tool": d.filter("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") > 1000).alias("is_viral"))}
    m = d.select("doc_id", (F.col("source") != "src0").alias("t"))
    each = [pipelines.compare_tools(m, "t", calls, "doc_id", missing).withColumn("missing", F.lit(missing)) for missing in ("negative", "skip")]
    return each[0].unionByName(each[1]).select("missing", "tp", "fp", "tn", "fn")


@query("SELECT source AS \"group\", count(*) AS n, count(DISTINCT lang) AS n_species FROM documents GROUP BY source")
def panel_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and species of a panel's groups."""
    return P.panel_census(table(spark, sf_dir, "documents").withColumnRenamed("source", "group"), "group", "lang")


@query("SELECT count(*) > 0 AS has_hits, count(*) AS n_hits, count(DISTINCT l_orderkey) AS n_queries, count(DISTINCT l_partkey) AS n_targets, count(*) || ' hits of ' || count(DISTINCT l_orderkey) || ' queries in ' || count(DISTINCT l_partkey) || ' targets' AS summary FROM lineitem")
def hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26."""
    return P.hit_summary(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size > 25 DESC, CASE WHEN p_size > 25 THEN p_brand ELSE '' END, p_name, p_partkey) AS BIGINT) AS place FROM part")
def coding_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding rows by lineage and name, then the others by name."""
    p = table(spark, sf_dir, "part").withColumn("coding", F.col("p_size") > 25).withColumn("named", F.struct("p_name", "p_partkey"))
    ordered = P.coding_first(p, "coding", "p_brand", "named").select("p_partkey").withColumn("at", F.monotonically_increasing_id())
    return ordered.select("p_partkey", F.expr("row_number() over (order by at)").cast("long").alias("place"))


@query("""SELECT CASE WHEN x.label = 0 AND y.label = 0 THEN 'stop-stop' WHEN x.label = 0 OR y.label = 0 THEN 'stop-sense' WHEN x.label = y.label THEN 'synonymous' ELSE 'between' END AS kind, CAST(count(*) AS BIGINT) AS n,
    round(avg(1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])), 6) AS mean FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id GROUP BY 1""")
def codon_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: distances between stop codons, stop and sense, synonymous and other codons."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 0, "*").otherwise(F.col("label").cast("string")).alias("amino"), "embedding")
    return P.codon_distances(e, "vec_id", "amino", "embedding").select("kind", F.col("n").cast("long").alias("n"), six("mean").alias("mean"))


@query("""WITH p AS (SELECT vec_id, [abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE), abs(embedding[3]::DOUBLE)] AS p FROM embeddings) SELECT vec_id, p[1] >= p[2] AND p[1] >= p[3] AS pred_viral FROM p""")
def viral_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the class itself counts as viral, not its sub-classes."""
    p = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).select("vec_id", rules.vote_of("p", ["viral", "phage", "cellular"], "viral").alias("pred_viral"))


@query("""SELECT doc_id, s AS start, least(s + 700, n) AS "end" FROM (SELECT doc_id, length(text) AS n, unnest(list_concat(range(0, greatest(length(text) - 700, 0) + 1, 300), CASE WHEN length(text) > (greatest(length(text) - 700, 0) // 300) * 300 + 700 THEN [(greatest(length(text) - 700, 0) // 300) * 300 + 300] ELSE [] END)) AS s FROM documents WHERE length(text) > 0)""")
def tile_by_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other rule for the end of a sequence."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return I.tile(d, "doc_id", F.length("text"), 700, 300, "step").select("doc_id", "start", "end")


@query(f"WITH {_X} SELECT seq, pos FROM (SELECT seq, pos, x, avg(x) OVER (PARTITION BY seq) + 2 * stddev_pop(x) OVER (PARTITION BY seq) AS lim FROM x) WHERE x > lim")
def high_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points above mean and two deviations."""
    return S.high_points(_positions(spark, sf_dir), "seq", "x").select("seq", "pos")


@query(f"WITH {_X} SELECT seq, pos, round(avg(x * x) OVER f - pow(avg(x) OVER f, 2), 6) + 0.0 AS frame_var FROM x WINDOW f AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def frame_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance in a sliding frame."""
    return S.frame_variance(_positions(spark, sf_dir), "seq", "pos", "x", 10).select("seq", "pos", six("frame_var").alias("frame_var"))

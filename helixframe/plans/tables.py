"""Queries on tables that analyses put together, and on the files beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers
from ..operators import tables as T
from ..sources import features
from .files import _text, _tsv, _written
from .positions import _P, _positions
from .registry import query, six, table


@query("""SELECT d.doc_id, d.lang, l.quality, l.toxic, CASE WHEN s.text IS NULL THEN 0.0 ELSE round(100.0 * (length(s.text) - length(regexp_replace(s.text, '[GCgc]', '', 'g'))) / greatest(length(s.text), 1), 1) END AS gc_content,
           CAST(coalesce(length(s.text), 0) AS BIGINT) AS seq_len
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN documents s ON s.doc_id = d.doc_id AND s.source = d.source AND s.n_chars > 600""")
def panel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with metrics, and the GC share and length of the sequences that are there."""
    d = table(spark, sf_dir, "documents")
    sequences = d.filter("n_chars > 600 AND source IS NOT NULL").select("doc_id", "text")
    return T.panel_with_metrics(d.select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), sequences, "doc_id", "text")


@query("""WITH s AS (SELECT l_partkey AS k, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS quantity, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS supplier FROM lineitem GROUP BY 1),
    t AS (SELECT l_partkey AS k, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT p_partkey, p_name AS taxonomy, s.quantity, s.supplier, t.price FROM part LEFT JOIN s ON s.k = p_partkey LEFT JOIN t ON t.k = p_partkey""")
def metadata_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with what three tables have on them; of several rows the last wins, some rows don't count."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    numbered = lines.withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return T.with_metadata(part.select("p_partkey"), "p_partkey", [
        T.Metadata(part, "p_partkey", {"taxonomy": "p_name"}),
        T.Metadata(numbered, "l_partkey", {"quantity": "l_quantity", "supplier": "l_suppkey"}, order="o"),
        T.Metadata(lines, "l_partkey", {"price": "l_extendedprice"}, where=F.col("l_returnflag") == "R", order="l_extendedprice"),
    ])


@query("""WITH b AS (SELECT l_orderkey, unnest([least(l_partkey, l_suppkey) - 1, greatest(l_partkey, l_suppkey) - 1]) AS b FROM lineitem)
    SELECT l_orderkey, CAST(count(DISTINCT b) AS INTEGER) AS n, array_to_string(list_sort(list(DISTINCT b)), ',') AS boundaries FROM b GROUP BY 1""")
def boundary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of a sequence's genes, distinct and sorted."""
    lists = T.boundary_lists(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey")
    return lists.select("l_orderkey", F.size("boundaries").alias("n"), F.array_join(F.col("boundaries").cast("array<string>"), ",").alias("boundaries"))


@query("""WITH c AS (SELECT coalesce(source, 'unknown') AS category, n_chars, text LIKE '%the%' AS hit FROM documents)
    SELECT replace(category, 'src', '') AS category, count(*) AS n, count_if(hit) AS n_hit, round(avg(n_chars), 6) AS gap, round(100.0 * count_if(hit) / count(*), 6) AS rate,
           CAST(list_position(['2', '0', '1', '3', 'unknown'], replace(category, 'src', '')) AS INTEGER) AS place
    FROM c GROUP BY 1 HAVING list_position(['2', '0', '1', '3', 'unknown'], replace(category, 'src', '')) > 0""")
def false_positive_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of renamed categories in the order of a list, with a mean to sort by."""
    d = table(spark, sf_dir, "documents")
    rates = T.rates_by_category(d, "source", F.coalesce(F.col("text").contains("the"), F.lit(False)), "src", ["2", "0", "1", "3", "unknown"], "n_chars")
    return T.by_category_and_gap(rates, "place", "gap").select("category", "n", "n_hit", six("gap").alias("gap"), six("rate").alias("rate"), "place")


@query("""SELECT doc_id, '500-1kb' AS bin FROM documents WHERE n_chars >= 500 AND n_chars < 1000 UNION ALL SELECT doc_id, '1-3kb' FROM documents WHERE n_chars >= 1000 AND n_chars < 3000
    UNION ALL SELECT doc_id, '2-5kb' FROM documents WHERE n_chars >= 2000 AND n_chars < 5000""")
def bin_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside every bin are dropped before sampling."""
    return T.bin_partition(table(spark, sf_dir, "documents"), "n_chars", [(500, 1000), (1000, 3000), (2000, 5000)]).select("doc_id", "bin")


@query(f"""WITH p AS ({_P}), s AS (SELECT seq, pos, sum(v[1]) OVER w / 20.0 AS cos1, sum(v[2]) OVER w / 20.0 AS cos3 FROM p WINDOW w AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
    SELECT seq, pos, round(cos1, 6) + 0.0 AS cos1, round(cos3, 6) + 0.0 AS cos3, round(cos3 - cos1, 6) + 0.0 AS inversion FROM s""")
def inversion_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed difference of two similarities along a sequence."""
    rows = _positions(spark, sf_dir).select("seq", "pos", F.col("embedding")[0].cast("double").alias("cos1"), F.col("embedding")[1].cast("double").alias("cos3"))
    return T.inversion_track(rows, "seq", "pos", "cos1", "cos3", 20).select("seq", "pos", six("cos1").alias("cos1"), six("cos3").alias("cos3"), six("inversion").alias("inversion"))


@query("""WITH s AS (SELECT doc_id, translate(text, 'acgt', 'ACGT') AS s FROM documents), c AS (SELECT doc_id, string_split(s, '') AS c FROM s), k AS (SELECT doc_id, len(c) AS n, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS kmer FROM c)
    SELECT doc_id, kmer, count(*) AS n, round(count(*) / greatest(max(n) - 1, 1), 6) AS freq FROM k WHERE regexp_full_match(kmer, '[ACGT]{2}') GROUP BY doc_id, kmer""")
def dinucleotides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of 2-mers over all pairs of neighbours, those with other letters included."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "acgt", "ACGT").alias("s"))
    f = kmers.kmer_features(s, "doc_id", "s", double=True)
    named = F.explode(F.arrays_zip(F.array(*(F.lit(x) for x in kmers.DIMERS)).alias("kmer"), F.slice("features", 65, 16).alias("freq")))
    rows = f.select("doc_id", named.alias("k")).select("doc_id", "k.kmer", "k.freq").filter("freq > 0")
    lengths = s.select("doc_id", F.greatest(F.char_length("s") - 1, F.lit(1)).alias("m"))
    rows = rows.join(lengths, "doc_id").withColumn("n", F.round(F.col("freq") * F.col("m")).cast("long"))
    return rows.select("doc_id", "kmer", "n", six(F.col("n") / F.col("m")).alias("freq"))


@query("SELECT 'p' || p_partkey AS protein_id, p_name AS annotation, CAST(p_size AS INTEGER) AS size FROM part")
def annotation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first table of a folder, keyed by its first column."""
    rows = table(spark, sf_dir, "part").select(_text("p", F.col("p_partkey")).alias("query"), F.col("p_name").alias("annotation"), "p_size")
    folder = _tsv(rows.coalesce(4), "annotations")
    return features.read_annotations(spark, folder, "*.csv", whole=True).select("protein_id", "annotation", F.col("p_size").cast("int").alias("size"))


@query("SELECT 'g' || l_orderkey AS contig_id, CAST(l_partkey - 1 AS BIGINT) AS start, CAST(l_partkey + l_linenumber AS BIGINT) AS \"end\" FROM lineitem WHERE l_linenumber % 2 = 1")
def coding_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding regions of a gene finder, starts from 0."""
    c = F.col
    kind = F.when(c("l_linenumber") % 2 == 1, "CDS").otherwise("gene")
    line = F.concat_ws("\t", _text("g", c("l_orderkey")), F.lit("finder"), kind, c("l_partkey").cast("string"), (c("l_partkey") + c("l_linenumber")).cast("string"), F.lit("."), F.lit("+"), F.lit("0"), F.lit("ID=x"))
    path = _written(table(spark, sf_dir, "lineitem").select(line.alias("value")), "genes.gff")
    return features.read_coding_regions(spark, path).select("contig_id", "start", "end")

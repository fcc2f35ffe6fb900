"""Queries that write rows of a table to files of a format and read them back: sources and sinks end to end."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..operators.persist import shared_folder
from ..sources import fasta, features, provider, sinks
from .registry import query, table


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files-{uuid4().hex}/{name}"


def _written(lines: DataFrame, name: str) -> str:
    """The folder of a table of one string column, written as text."""
    path = _path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _tsv(df: DataFrame, name: str, header: bool = True, sep: str = "\t") -> str:
    path = _path(df.sparkSession, name)
    df.write.csv(path, sep=sep, header=header)
    return path


_DNA = "translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacn')"


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sequences: their names in letters of bases."""
    s = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", "acgtacgtacgtacgtacgtacgtacn")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("seq_"), F.col("p_partkey").cast("string")).alias("sequence_id"), s.alias("sequence"))


def _text(*parts: str | Column) -> Column:
    """Strings, and columns as strings, one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("value")


@query(f"SELECT 'seq_' || p_partkey AS sequence_id, 'seq_' || p_partkey || ' a part' AS description, upper({_DNA}) AS sequence FROM part")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with descriptions, wrapped, read back with capitals."""
    rows = _dna(spark, sf_dir).select(F.concat_ws(" ", "sequence_id", F.lit("a part")).alias("id"), "sequence")
    path = _path(spark, "parts.fasta")
    sinks.write_fasta(rows, path, "id", "sequence", 20)
    return fasta.read_fasta(spark, path).select("sequence_id", "description", "sequence")


@query(f"SELECT 'seq_' || (p_partkey % 40) AS sequence_id, upper(arg_max({_DNA}, p_partkey)) AS sequence FROM part GROUP BY 1")
def fasta_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of records with one id the last stands."""
    rows = _dna(spark, sf_dir).select("k", F.concat(F.lit("seq_"), (F.col("k") % 40).cast("string")).alias("sequence_id"), "sequence")
    path = _path(spark, "repeated.fasta")
    sinks.write_fasta(rows.coalesce(1).sortWithinPartitions("k"), path)
    return fasta.read_fasta(spark, path).select("sequence_id", "sequence")


@query(f"SELECT CASE WHEN p_partkey % 3 = 0 THEN 'NC_' ELSE 'XX_' END || p_partkey AS sequence_id, translate(upper({_DNA}), 'U', 'T') AS sequence FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0")
def genome_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with a prefix, RNA as DNA, clean letters only."""
    k = F.col("k")
    rows = _dna(spark, sf_dir).select(_text(F.when(k % 3 == 0, "NC_").otherwise("XX_"), k).alias("id"), F.when(k % 5 == 0, F.concat("sequence", F.lit("q"))).otherwise(F.translate("sequence", "t", "u")).alias("s"))
    path = _path(spark, "genomes.fasta")
    sinks.write_fasta(rows, path, "id", "s")
    return fasta.read_genomes(spark, path).select("sequence_id", "sequence")


@query(f"SELECT count(*) AS n_records, max(CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part) THEN length({_DNA}) END) AS length FROM part")
def alignment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an alignment and the first one's length."""
    path = _path(spark, "alignment.fasta")
    sinks.write_fasta(_dna(spark, sf_dir).coalesce(1).sortWithinPartitions("k"), path)
    return fasta.alignment_shape(spark, path).select(F.col("n_sequences").alias("n_records"), F.col("alignment_length").cast("long").alias("length"))


@query("""SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'ctg_' || (s_suppkey % 9) || '_' || s_suppkey || '_' || (s_suppkey + 90) ELSE 'orf' || s_suppkey END AS orf_id, 'ctg_' || (s_suppkey % 9) AS contig_id, s_suppkey AS start, s_suppkey + 90 AS "end",
    CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier WHERE s_suppkey % 3 <> 2""")
def gff_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes and coding regions of GFF3 lines, told by the file's name."""
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "CDS").when(k % 3 == 1, "gene").otherwise("mRNA")
    line = F.concat_ws("\t", _text("ctg_", k % 9), F.lit("src"), kind, k.cast("string"), (k + 90).cast("string"), F.lit("."), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("0"), F.when(k % 4 == 0, "note=x").otherwise(_text("ID=orf", k, ";note=y")))
    s = table(spark, sf_dir, "supplier")
    lines = s.select(line.alias("value")).unionByName(s.select(F.lit("# comment").alias("value"))).unionByName(s.select(F.lit("too\tfew").alias("value")))
    return features.read_orfs(spark, _written(lines, "genes.gff3")).select("orf_id", "contig_id", "start", "end", "strand")


@query("""SELECT 'ctg_' || (s_suppkey % 9) || '_' || s_suppkey AS orf_id, 'ctg_' || (s_suppkey % 9) AS contig_id, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey * 3 END AS start, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey * 3 + 99 END AS "end",
    CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'MKV' AS protein_sequence FROM supplier""")
def protein_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene callers' headers and plain ones in one FASTA file."""
    k = F.col("s_suppkey")
    name = _text("ctg_", k % 9, "_", k)
    header = F.when(k % 3 == 0, name).otherwise(F.concat_ws(" # ", name, (k * 3).cast("string"), (k * 3 + 99).cast("string"), F.when(k % 2 == 0, "1").otherwise("-1"), F.lit("ID=1")))
    path = _path(spark, "proteins.faa")
    sinks.write_fasta(table(spark, sf_dir, "supplier").select(header.alias("h"), F.lit("MKV").alias("s")), path, "h", "s")
    return features.read_orfs(spark, path).select("orf_id", "contig_id", "start", "end", "strand", "protein_sequence")


@query("SELECT 'seq_' || doc_id AS sequence_id, CAST(toxic AS VARCHAR) AS label FROM labels WHERE toxic IS NOT NULL")
def label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by place, whatever the header says."""
    rows = table(spark, sf_dir, "labels").filter("toxic is not null").select(_text("seq_", F.col("doc_id")).alias(" the id "), F.col("toxic").alias("its label"))
    return features.read_labels(spark, _tsv(rows, "labels.tsv"))


@query("SELECT lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names become the ranks of their order."""
    rows = table(spark, sf_dir, "documents").filter("lang is not null").select(F.col("lang").alias("label"), F.col("lang").alias("code"))
    return features.encode_labels(rows, "code")[0].groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'q' || l_orderkey AS query, 't' || l_partkey AS target, l_linenumber AS alnlen, l_quantity AS evalue, 'pdb' AS source_db FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL
    SELECT 'q' || l_orderkey, 't' || l_partkey, l_linenumber, l_quantity, 'afdb' FROM lineitem WHERE l_orderkey % 2 = 0""")
def hit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of 19 columns without a header, tagged by database."""
    from ..operators.lookups import tagged_union

    names = [c.split()[0] for c in features.HIT_SCHEMA.split(", ")]
    own = {"query": _text("q", F.col("l_orderkey")), "target": _text("t", F.col("l_partkey")), "alnlen": F.col("l_linenumber"), "evalue": F.col("l_quantity")}
    parts = {}
    for i, db in ((1, "pdb"), (0, "afdb")):
        rows = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 2 == i).select(*(own.get(n, F.lit("1")).alias(n) for n in names))
        parts[db] = features.read_hits(spark, _tsv(rows, f"{db}.m8", header=False))
    return tagged_union(parts, "source_db").select("query", "target", "alnlen", "evalue", "source_db")


@query("""SELECT 'c' || (c_custkey // 2) AS sequence_id, true AS is_viral FROM customer GROUP BY 1, 2""")
def virus_summary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence means viral; a provirus counts for its sequence."""
    k = F.col("c_custkey")
    name = F.concat(_text("c", F.floor(k / 2)), F.when(k % 2 == 0, _text("|provirus_", k, "_9")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "customer").select(name.alias("seq_name"), F.lit("0.9").alias("virus_score"))
    return features.read_virus_summary(spark, _tsv(rows, "virus_summary.tsv")).select("sequence_id", "is_viral")


@query("SELECT 'e' || event_id AS sequence_id, value / 50 >= 0.5 AND (event_id % 100) / 1000 < 0.05 AS is_viral, value / 50 AS score, CASE WHEN (event_id % 100) / 1000 < 0.05 THEN value / 50 ELSE 0 END AS gated FROM events")
def scored_calls_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that count only where they are significant."""
    rows = table(spark, sf_dir, "events").select(_text("e", F.col("event_id"), " length").alias("name"), (F.col("value") / 50).alias("score"), (F.col("event_id") % 100 / 1000).alias("pvalue"))
    return features.read_scored_calls(spark, _tsv(rows, "scored.tsv"))


@query("SELECT DISTINCT 'o' || (o_orderkey % 1000) AS sequence_id, true AS is_viral FROM orders")
def split_calls_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids before a double bar."""
    rows = table(spark, sf_dir, "orders").select(_text("o", F.col("o_orderkey") % 1000, "||", F.col("o_orderkey") % 3).alias("seqname"), F.lit("x").alias("group"))
    return features.read_split_calls(spark, _tsv(rows, "split.tsv"))


@query("SELECT DISTINCT 'n' || (s_suppkey // 3) AS sequence_id, true AS is_viral FROM supplier")
def name_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of a FASTA file as calls."""
    path = _path(spark, "phages.fna")
    sinks.write_fasta(table(spark, sf_dir, "supplier").select(_text("n", F.floor(F.col("s_suppkey") / 3), " fragment").alias("h"), F.lit("ACGT").alias("s")), path, "h", "s")
    return features.read_name_list(spark, path)


@query("SELECT 'e' || user_id AS sequence_id, CAST(event_id AS BIGINT) AS start, CAST(event_id + 500 AS BIGINT) AS \"end\" FROM events WHERE event_type = 'purchase'")
def provirus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates in one column, beside a name with a suffix."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(_text("e", F.col("user_id"), "|provirus_1_2").alias("seq_name"), F.concat_ws("-", "event_id", F.col("event_id") + 500).alias("coordinates"))
    return features.read_proviruses(spark, _tsv(rows, "provirus.tsv"))


@query("SELECT 'd' || doc_id AS sequence_id, lang AS checkv_quality FROM documents WHERE source = 'src0'")
def quality_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of qualities, of one sample."""
    rows = table(spark, sf_dir, "documents").select(_text("d", F.col("doc_id")).alias("contig_id"), F.col("lang").alias("checkv_quality"), F.col("source").alias("sample"))
    return features.read_quality(spark, _tsv(rows, "quality.csv", sep=","), "src0").select("sequence_id", "checkv_quality")


@query("SELECT 'e' || event_id AS sequence_id, value AS score, event_type AS classification FROM events")
def score_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table of this library, written and read."""
    rows = table(spark, sf_dir, "events").select(_text("e", F.col("event_id")).alias("contig_id"), F.col("value").alias("viral_score"), F.col("event_type").alias("classification"))
    path = _path(spark, "results.tsv")
    sinks.write_tsv(rows, path)
    return features.read_scores(spark, path)


@query("SELECT round(avg(s_suppkey % 90), 6) AS mean_confidence FROM supplier WHERE s_suppkey % 7 <> 0")
def confidence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of characters 61 to 66 of a structure's atoms; unreadable ones are skipped."""
    k = F.col("s_suppkey")
    atom = F.concat(F.rpad(F.when(k % 2 == 0, "ATOM").otherwise("HETATM"), 60, " "), F.lpad(F.when(k % 7 == 0, "??").otherwise((k % 90).cast("string")), 6, " "), F.lit("  C"))
    s = table(spark, sf_dir, "supplier")
    lines = s.select(atom.alias("value")).unionByName(s.select(F.rpad(F.lit("REMARK"), 80, "9").alias("value"))).coalesce(1)
    found = features.read_confidence(spark, _written(lines, "model.pdb")).filter("mean_confidence is not null")
    return found.select(F.round("mean_confidence", 6).alias("mean_confidence"))


@query("SELECT 'g' || n_nationkey AS gene, n_regionkey * 1000 AS length, n_nationkey + 1 AS n_exons FROM nation")
def interval_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of genes to intervals; a later file replaces an earlier one's entries."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    exons = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((i * 10).alias("start"), (i * 10 + 5).alias("end")))
    nation = table(spark, sf_dir, "nation")
    one = lambda length, keep: nation.filter(keep).groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(_text("g", k).alias("g"), F.struct(exons.alias("exons"), exons.alias("cds"), length.alias("length")).alias("v"))))).alias("value"))
    first, second = _written(one(F.lit(7), F.lit(True)), "a.json"), _written(one(r * 1000, k >= 0), "b.json")
    return features.read_intervals_json(spark, [first, second]).select("gene", "length", F.size("exons").cast("long").alias("n_exons"))


@query("SELECT 's' || s_suppkey AS gene, CASE WHEN s_suppkey % 2 = 0 THEN 'TGCA' ELSE 'GCATT' END AS cds FROM supplier")
def coded_by_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding sequences from qualifiers: joined parts, or the other strand."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(_text("s", k).alias("gene"), F.when(k % 2 == 0, "complement(AB1.1:2..5)").otherwise("join(AB1.1:3..5,AB1.1:9..10)").alias("q"), F.lit("CTGCATGATT").alias("s"))
    return rows.select("gene", features.coding_sequence("s", features.coded_by("q")).alias("cds"))


@query("SELECT user_id AS chrom, event_id AS start, event_id + 9 AS \"end\", CAST(least(1000, trunc(value / 60 * 1000)) AS INTEGER) AS score FROM events WHERE event_type = 'purchase'")
def bed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: regions written as BED."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    path = _path(spark, "regions.bed")
    sinks.write_bed(e.select(F.col("user_id").alias("chromosome_id"), F.col("event_id").alias("start"), (F.col("event_id") + 9).alias("end"), F.lit("r").alias("region_id"), (F.col("value") / 60).alias("mean_score")), path)
    return spark.read.csv(path, sep="\t", schema="chrom long, start long, end long, name string, score int, strand string").select("chrom", "start", "end", "score")


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON lines."""
    path = _path(spark, "rows.json")
    sinks.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return spark.read.schema("doc_id long, lang string, n_chars long").json(path)


@query("""SELECT 'v' || vec_id AS sequence_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 4) AS square FROM embeddings WHERE vec_id % 2 = 0
    UNION ALL SELECT 'v' || vec_id, round(4 * list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 4) FROM embeddings WHERE vec_id % 2 = 1""")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends to a cache, the later of an id's rows, compacted."""
    cache = provider.Cache(spark, _path(spark, "cache"), "model", "blocks.1")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _text("v", F.col("vec_id")).alias("sequence_id"), "embedding")
    cache.append(rows.select("sequence_id", "embedding"))
    cache.append(rows.filter("vec_id % 2 = 1").select("sequence_id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding")))
    cache.compact()
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return cache.read().select("sequence_id", F.round(square, 4).alias("square"))


@query("SELECT 'v' || vec_id AS sequence_id, row_number() OVER (ORDER BY vec_id DESC) AS place FROM embeddings WHERE vec_id % 3 = 0")
def ordered_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of wanted ids in the wanted order; ids without one are left out."""
    from pyspark.sql import Window

    cache = provider.Cache(spark, _path(spark, "cache"), "model", "blocks.1")
    e = table(spark, sf_dir, "embeddings")
    cache.append(e.filter("vec_id % 3 = 0").select(_text("v", F.col("vec_id")).alias("sequence_id"), "embedding"))
    wanted = e.select(_text("v", F.col("vec_id")).alias("sequence_id"), (-F.col("vec_id")).alias("seq_ord"))
    got = cache.gather(wanted, order="seq_ord")
    return got.select("sequence_id", F.row_number().over(Window.orderBy("seq_ord")).cast("long").alias("place"))


@query("SELECT 'seq/' || p_partkey AS sequence_id, CASE WHEN p_partkey % 3 = 0 THEN 'seq_' || p_partkey || '.npy' END AS file FROM part")
def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of an id under its safe name."""
    p = table(spark, sf_dir, "part").select("p_partkey", _text("seq/", F.col("p_partkey")).alias("sequence_id"))
    files = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("/data/"), seq.safe_name("sequence_id"), F.lit(".npy")).alias("path"))
    found = features.match_files(p.select("sequence_id"), files)
    return found.select("sequence_id", F.element_at(F.split("path", "/"), -1).alias("file"))

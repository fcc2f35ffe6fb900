"""Readers of feature tables: GFF3, open reading frames, labels, predictions of other tools, structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a structural hit table, in order, without a header.
HIT_SCHEMA = (
    "query string, target string, fident double, alnlen int, mismatch int, gapopen int, qstart int, qend int, tstart int, tend int, evalue double, bits double, "
    "prob double, lddt double, alntmscore double, qtmscore double, ttmscore double, taxid string, taxname string"
)


def read_gff(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("CDS", "gene")) -> DataFrame:
    """(orf_id, contig_id, start, end, strand): comments and lines under 9 fields are skipped; without an ID one is made of contig and coordinates."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(f.alias("f")).filter(F.size("f") >= 9)
    kept = lines.filter(F.col("f")[2].isin(*kinds))
    named = F.nullif(F.regexp_extract(F.col("f")[8], r"(?:^|;)ID=([^;]*)", 1), F.lit(""))
    return kept.select(
        F.coalesce(named, F.concat_ws("_", F.col("f")[0], F.col("f")[3], F.col("f")[4])).alias("orf_id"), F.col("f")[0].alias("contig_id"),
        F.col("f")[3].cast("long").alias("start"), F.col("f")[4].cast("long").alias("end"), F.col("f")[6].alias("strand"), F.lit(None).cast("string").alias("protein_sequence"),
    )


def orf_header(header: Column) -> Column:
    """Struct of a gene caller's record header: fields between ` # `; missing coordinates are 0, a missing strand +."""
    parts = F.split(header, " # ")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    name = F.element_at(F.split(part(1), r"\s+"), 1)
    number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0).cast("long"))
    strand = F.when(F.coalesce(F.trim(part(4)), F.lit("1")) == "1", "+").otherwise("-")
    return F.struct(name.alias("orf_id"), F.regexp_replace(name, "_[^_]*$", "").alias("contig_id"), number(2).alias("start"), number(3).alias("end"), strand.alias("strand"))


def read_orfs(spark: SparkSession, path: str) -> DataFrame:
    """Open reading frames of a GFF3 or protein FASTA file: told by the name, else by the first line."""
    from .fasta import read_fasta

    low = path.lower()
    if low.endswith((".gff", ".gff3")):
        return read_gff(spark, path)
    first = [r.value for r in spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()]
    if not low.endswith((".faa", ".fa", ".fasta", ".fna")) and first and first[0].startswith("##gff"):
        return read_gff(spark, path)
    if not first or not first[0].startswith(">"):
        raise ValueError(f"neither GFF3 nor FASTA: {path}")
    rows = read_fasta(spark, path, unique=False)
    called = rows.select(orf_header(F.col("description")).alias("h"), F.col("sequence").alias("protein_sequence"), F.col("description").contains(" # ").alias("called"), F.col("sequence_id"))
    plain = F.struct(F.col("sequence_id").alias("orf_id"), F.regexp_replace("sequence_id", "_[^_]*$", "").alias("contig_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("+").alias("strand"))
    return called.select(F.when(F.col("called"), F.col("h")).otherwise(plain).alias("h"), "protein_sequence").select("h.*", "protein_sequence")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, label): the first two columns of a TSV with a header, whatever their names."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(F.trim(df[df.columns[0]]).alias("sequence_id"), F.trim(df[df.columns[1]]).alias("label"))


def encode_labels(df: DataFrame, label: str = "label") -> tuple[DataFrame, list[str]]:
    """Labels as numbers: integers stay, else ranks of the sorted names. Classes are few and read once."""
    names = [r[0] for r in df.select(label).distinct().collect()]
    if all(n is not None and n.lstrip("-").isdigit() for n in map(lambda x: None if x is None else str(x), names)):
        return df.withColumn(label, F.col(label).cast("int")), [str(n) for n in sorted(int(n) for n in names)]
    order = sorted(str(n) for n in names)
    number = F.create_map(*(F.lit(x) for i, n in enumerate(order) for x in (n, i)))
    return df.withColumn(label, number[F.col(label).cast("string")]), order


def read_hits(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    df = spark.read.csv(path, sep="\t", schema=HIT_SCHEMA)
    return df.withColumn("source_db", F.lit(source)) if source else df


def read_virus_summary(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, is_viral, score) of a summary in which presence means viral; a provirus counts for its sequence."""
    df = spark.read.csv(path, sep="\t", header=True, recursiveFileLookup=True)
    return df.select(F.regexp_replace("seq_name", r"^(.*)\|provirus.*$", "$1").alias("sequence_id"), F.lit(True).alias("is_viral"), F.col("virus_score").try_cast("double").alias("score")).dropDuplicates(["sequence_id"])


def read_scored_calls(spark: SparkSession, path: str, score: float = 0.5, p: float = 0.05) -> DataFrame:
    """(sequence_id, is_viral, score, gated) of a table with name, score and pvalue columns; gated: the score, or 0 where it isn't significant."""
    df = spark.read.csv(path, sep="\t", header=True)
    s, q = F.col("score").try_cast("double"), F.col("pvalue").try_cast("double")
    return df.select(F.element_at(F.split("name", r"\s+"), 1).alias("sequence_id"), ((s >= score) & (q < p)).alias("is_viral"), s.alias("score"), F.when(q < p, s).otherwise(0.0).alias("gated"))


def read_split_calls(spark: SparkSession, path: str) -> DataFrame:
    """Presence means viral; the id stands before a double bar."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(F.substring_index(df[df.columns[0]], "||", 1).alias("sequence_id"), F.lit(True).alias("is_viral")).dropDuplicates(["sequence_id"])


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a list, a FASTA or the first column of a table: presence means viral."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''")
    first = [r.v for r in t.limit(1).collect()]
    if first and first[0].startswith(">"):
        t = t.filter(F.col("v").startswith(">")).select(F.substring("v", 2, 1 << 20).alias("v"))
    elif first and "\t" in first[0]:
        t = t.filter(F.col("v") != first[0])
    return t.select(F.element_at(F.split("v", r"\s+"), 1).alias("sequence_id"), F.lit(True).alias("is_viral")).dropDuplicates(["sequence_id"])


def read_proviruses(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, start, end): coordinates from whichever of the known columns there are, or from one that holds `a-b`."""
    df = spark.read.csv(path, sep="\t", header=True)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    span = F.split(pick("coordinates"), "-")
    start = F.coalesce(pick("start", "start_pos", "provirus_start").try_cast("long"), F.try_element_at(span, F.lit(1)).try_cast("long"))
    end = F.coalesce(pick("end", "end_pos", "provirus_end").try_cast("long"), F.try_element_at(span, F.lit(2)).try_cast("long"))
    name = F.regexp_replace(pick("source_seq", "seq_name", "contig"), r"^(.*)\|provirus.*$", "$1")
    return df.select(name.alias("sequence_id"), start.alias("start"), end.alias("end")).filter("sequence_id is not null and start is not null and end is not null")


def read_quality(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """(sequence_id, checkv_quality, ...) of a CSV of contig qualities, of one sample if it is named."""
    df = spark.read.csv(path, header=True)
    kept = df.filter(F.col("sample") == sample) if sample is not None else df
    return kept.withColumnRenamed(df.columns[0] if "contig_id" not in df.columns else "contig_id", "sequence_id")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, score, classification) of a result table of this library, whichever names its id and score have."""
    df = spark.read.csv(path, sep="\t", header=True)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    return df.select(pick("contig_id", "sequence_id", "seq_name").alias("sequence_id"), pick("viral_score", "score", "virus_score").try_cast("double").alias("score"), pick("classification", "class").alias("classification"))


def read_confidence(spark: SparkSession, path: str) -> DataFrame:
    """(path, mean_confidence) of structure files: the mean of characters 61 to 66 of atom lines; unreadable ones are skipped."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value")
    atoms = lines.filter(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    value = F.trim(F.substring("value", 61, 6)).try_cast("double")
    return lines.select("path").distinct().join(atoms.groupBy("path").agg(F.avg(value).alias("mean_confidence")), "path", "left")


def predicted_structures(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path): the first file by name of each predicted structure, its name before the rank marker."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdb").load(folder).select("path")
    base = F.element_at(F.split("path", "/"), -1)
    name = F.regexp_extract(base, r"^(.*?)_(?:un)?relaxed_rank_001", 1)
    return files.select(name.alias("name"), "path").filter("name <> ''").groupBy("name").agg(F.min("path").alias("path"))


def read_intervals_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(gene, exons, cds, length) of annotation maps; a later file's entry replaces an earlier one's."""
    kind = "map<string,struct<exons:array<struct<start:bigint,end:bigint>>,cds:array<struct<start:bigint,end:bigint>>,length:bigint>>"
    frames = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("o"), F.explode(F.from_json("value", kind)).alias("gene", "v")) for i, p in enumerate(paths)]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return both.groupBy("gene").agg(F.max_by("v", "o").alias("v")).select("gene", "v.*")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, embedding) of archives of `sequence_ids` and `embeddings`; nothing pickled is read."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for body in pdf["content"]:
                with np.load(io.BytesIO(body), allow_pickle=False) as z:
                    ids, x = z["sequence_ids"].astype(str), z["embeddings"]
                    for at in range(0, len(ids), 1024):
                        yield pd.DataFrame({"sequence_id": ids[at : at + 1024], "embedding": list(x[at : at + 1024].astype(np.float32).tolist())})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(each, "sequence_id string, embedding array<float>")


def match_files(ids: DataFrame, files: DataFrame, key: str = "sequence_id", path: str = "path") -> DataFrame:
    """ids with the file named for each: the safe name of at most 80 letters, else a file that shares its first 40; the smaller path on a tie."""
    safe = F.substring(F.replace(F.col(key), F.lit("/"), F.lit("_")), 1, 80)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    by = files.select(F.col(path).alias("_path"), stem.alias("_stem"))
    exact = by.groupBy("_stem").agg(F.min("_path").alias("_exact"))
    near = by.groupBy(F.substring("_stem", 1, 40).alias("_head")).agg(F.min("_path").alias("_near"))
    named = ids.withColumn("_stem", safe).withColumn("_head", F.substring(safe, 1, 40))
    out = named.join(exact, "_stem", "left").join(near, "_head", "left")
    return out.withColumn(path, F.coalesce("_exact", "_near")).drop("_stem", "_head", "_exact", "_near")


def coded_by(text: str | Column) -> Column:
    """Struct of a `coded_by` qualifier: accession, whether it is on the other strand, and its parts (start from 1, end)."""
    c = F.col(text) if isinstance(text, str) else text
    spans = F.regexp_extract_all(c, F.lit(r"[<>]?(\d+)\.\.[<>]?(\d+)"), 0)
    number = lambda x, i: F.regexp_extract(x, r"(\d+)\.\.[<>]?(\d+)", i).cast("long")
    parts = F.transform(spans, lambda x: F.struct(number(x, 1).alias("start"), number(x, 2).alias("end")))
    return F.struct(F.regexp_extract(c, r"([A-Za-z_0-9.]+):", 1).alias("accession"), c.startswith("complement").alias("reverse"), parts.alias("parts"))


def coding_sequence(sequence: str | Column, coded: Column) -> Column:
    """The parts of a sequence joined, turned around on the other strand."""
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    joined = F.array_join(F.transform(coded["parts"], lambda p: F.substring(s, p["start"].cast("int"), (p["end"] - p["start"] + 1).cast("int"))), "")
    return F.when(coded["reverse"], F.reverse(F.translate(joined, "ACGTacgt", "TGCAtgca"))).otherwise(joined)


def read_coding_regions(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, start, end): the coding regions of a gene finder's GFF3, starts from 0."""
    return read_gff(spark, path, ("CDS",)).select("contig_id", (F.col("start") - 1).alias("start"), "end")


def read_annotations(spark: SparkSession, path: str, pattern: str = "*.tsv", whole: bool = False) -> DataFrame:
    """An annotation table, its first column named protein_id: a file, or of a folder the first file by name that fits the pattern.

    whole: all fitting files of the folder are one table, as Spark writes it. A folder without such a file is an error.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        found = sorted(str(s.getPath().toString()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, pattern)))
        if not found:
            raise FileNotFoundError(f"no {pattern} in {path}")
        files = found if whole else found[:1]
    else:
        files = [path]
    df = spark.read.csv(files, sep="\t", header=True)
    return df.withColumnRenamed(df.columns[0], "protein_id")

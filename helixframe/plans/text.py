"""Queries on texts as sequences, on names and on annotations made of part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, seq
from ..functions import vocabulary as V
from ..operators import kmers
from .registry import query, six, table

_UP = "translate(text, 'acgtn', 'ACGTN')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "acgtn", "ACGTN").alias("s"))


@query(f"""WITH s AS (SELECT doc_id, {_UP} AS s FROM documents), k AS (SELECT doc_id, substr(s, CAST(i AS BIGINT), 3) AS k, length(s) - 2 AS n FROM s, LATERAL (SELECT unnest(range(1, length(s) - 1)) AS i))
    SELECT doc_id, k AS kmer, count(*) AS n, round(count(*) / max(n), 6) AS freq FROM k WHERE regexp_full_match(k, '[ACGT]{{3}}') GROUP BY doc_id, k""")
def kmer_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = kmers.kmer_features(_texts(spark, sf_dir), "doc_id", "s", double=True)
    named = F.explode(F.arrays_zip(F.array(*(F.lit(x) for x in kmers.TRIMERS)).alias("kmer"), F.slice("features", 1, 64).alias("freq")))
    lengths = _texts(spark, sf_dir).select("doc_id", F.greatest(F.length("s") - 2, F.lit(1)).alias("m"))
    rows = f.select("doc_id", named.alias("k")).select("doc_id", "k.kmer", F.col("k.freq").cast("double").alias("freq")).filter("freq > 0").join(lengths, "doc_id")
    rows = rows.withColumn("n", F.round(F.col("freq") * F.col("m")).cast("long"))
    return rows.select("doc_id", "kmer", "n", six(F.col("n") / F.col("m")).alias("freq"))


def _frame_sql(offset: int) -> str:
    return f"(SELECT doc_id, -sum(c / t * log2(c / t)) AS h FROM (SELECT doc_id, k, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, substr(s, CAST(i AS BIGINT), 3) AS k FROM s, LATERAL (SELECT unnest(range({offset + 1}, length(s) - 1, 3)) AS i)) GROUP BY doc_id, k) GROUP BY doc_id)"


@query(f"""WITH s AS (SELECT doc_id, {_UP} AS s FROM documents), a AS {_frame_sql(0)}, b AS {_frame_sql(1)}
    SELECT s.doc_id, round(coalesce(a.h, 0), 6) AS in_frame, round(coalesce(b.h, 0), 6) AS out_frame, round(length(regexp_replace(s.s, '[^GC]', '', 'g')) / greatest(length(s.s), 1), 6) AS gc FROM s LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def kmer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = kmers.kmer_features(_texts(spark, sf_dir), "doc_id", "s", double=True)
    at = lambda i: F.round(F.col("features")[i], 6) + F.lit(0.0)
    return f.select("doc_id", at(81).alias("in_frame"), at(82).alias("out_frame"), at(80).alias("gc"))


@query(f"SELECT doc_id, round(length(regexp_replace({_UP}, '[^GC]', '', 'g')) / greatest(length(text), 1), 6) AS gc, round(length(regexp_replace({_UP}, '[^N]', '', 'g')) / greatest(length(text), 1), 6) AS n_share, length(regexp_replace({_UP}, '[^N]', '', 'g')) / greatest(length(text), 1) <= 0.05 AS passes FROM documents")
def gc_like_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", six(seq.gc_fraction("s")).alias("gc"), six(seq.n_fraction("s")).alias("n_share"), (seq.n_fraction("s") <= 0.05).alias("passes"))


@query(f"SELECT doc_id, md5(regexp_replace({_UP}, '[^ACGTN]', 'N', 'g')) AS cleaned, length(text) AS n, regexp_full_match({_UP}, '[ACGTN]+') AS clean FROM documents")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(seq.ambiguity_to_n("s")).alias("cleaned"), F.length("s").cast("long").alias("n"), seq.is_clean("s").alias("clean"))


@query(f"SELECT doc_id, md5(list_aggregate(list_reverse(regexp_extract_all(translate({_UP}, 'ACGTacgtNn', 'TGCAtgcaNn'), '(?s).')), 'string_agg', '')) AS revcomp FROM documents WHERE text <> '' UNION ALL SELECT doc_id, md5(text) FROM documents WHERE text = '' OR text IS NULL")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(seq.reverse_complement("s")).alias("revcomp"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 500 AND 16000")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.length("text").between(500, 16000)).select("doc_id", "n_chars")


@query("""SELECT length_bin, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, CASE WHEN n_chars >= 500 AND n_chars < 1000 THEN '500-1000' WHEN n_chars >= 1000 AND n_chars < 3000 THEN '1000-3000' WHEN n_chars >= 3000 AND n_chars < 5000 THEN '3000-5000'
    WHEN n_chars >= 5000 AND n_chars < 10000 THEN '5000-10000' WHEN n_chars >= 10000 AND n_chars <= 16000 THEN '10000-16000' ELSE 'other' END AS length_bin FROM documents) GROUP BY 1""")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("n_chars", rules.length_bin("n_chars", closed_top=True).alias("length_bin"))
    return d.groupBy("length_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) % 80 = 0 THEN left(w, length(w) - 1) ELSE w END) AS wrapped FROM (SELECT doc_id, text, regexp_replace(text, '(.{80})', '\\1' || chr(10), 'gs') AS w FROM documents)""")
def fasta_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(seq.wrap("text", 80)).alias("wrapped"))


#: A word of each table stands for each part, so that annotations of all kinds come about.
_WORDS = {"domain": V.DOMAINS, "superfamily": V.SUPERFAMILIES, "process": V.PROCESSES, "function": V.FUNCTIONS}


def _list_sql(table_: dict[str, list[str]]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for _, w in V.words(table_)) + "]"


def _case_sql(column: str, table_: dict[str, list[str]]) -> str:
    arms = []
    for category, row in table_.items():
        any_of = " OR ".join(f"contains(lower({column}), '{w.replace(chr(39), chr(39) * 2)}')" for w in row)
        arms.append(f"WHEN {any_of} THEN '{category}'")
    return f"CASE {' '.join(arms)} END"


def _keyword_sql(column: str) -> str:
    arms = []
    for category, word in V.words(V.KEYWORDS):
        w = word.replace("'", "''")
        at = f"strpos({column}, '{w}')"
        if category == "host_interaction":
            arms.append(f"WHEN {at} > 0 THEN 'host_interaction'")
        else:
            after, before = f"substr({column}, {at} + {len(word)}, 30)", f"substr({column}, greatest({at} - 15, 1), least({at} - 1, 15))"
            arms.append(f"WHEN {at} > 0 THEN CASE WHEN contains({after}, 'inhibitor') OR contains({after}, 'inhibition') OR contains({before}, 'host') THEN 'host_interaction' ELSE '{category}' END")
    return f"CASE {' '.join(arms)} ELSE 'unknown' END"


_ANNOTATED = f"""SELECT p_partkey AS part, p_name || ' ' || {_list_sql(V.KEYWORDS)}[p_partkey % {len(V.words(V.KEYWORDS))} + 1] || CASE WHEN p_partkey % 5 = 0 THEN ' inhibitor' WHEN p_partkey % 7 = 0 THEN ' protein' ELSE '' END AS description,
    CASE WHEN p_partkey % 3 = 0 THEN 'Some ' || upper({_list_sql(V.DOMAINS)}[p_partkey % {len(V.words(V.DOMAINS))} + 1]) WHEN p_partkey % 3 = 1 THEN 'nothing known' END AS domain,
    CASE WHEN p_partkey % 4 = 0 THEN {_list_sql(V.SUPERFAMILIES)}[p_partkey % {len(V.words(V.SUPERFAMILIES))} + 1] END AS superfamily,
    CASE WHEN p_partkey % 5 = 1 THEN {_list_sql(V.PROCESSES)}[p_partkey % {len(V.words(V.PROCESSES))} + 1] END AS process, CASE WHEN p_partkey % 6 = 1 THEN {_list_sql(V.FUNCTIONS)}[p_partkey % {len(V.words(V.FUNCTIONS))} + 1] END AS function FROM part"""


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")

    def word(table_: dict[str, list[str]]):
        words = [w for _, w in V.words(table_)]
        return F.element_at(F.expr("array(" + ", ".join(map(rules.quoted, words)) + ")"), (F.pmod(k, F.lit(len(words))) + 1).cast("int"))

    tail = F.when(k % 5 == 0, " inhibitor").when(k % 7 == 0, " protein").otherwise("")
    return table(spark, sf_dir, "part").select(
        k.alias("part"), F.concat("p_name", F.lit(" "), word(V.KEYWORDS), tail).alias("description"),
        F.when(k % 3 == 0, F.concat(F.lit("Some "), F.upper(word(V.DOMAINS)))).when(k % 3 == 1, "nothing known").alias("domain"),
        F.when(k % 4 == 0, word(V.SUPERFAMILIES)).alias("superfamily"), F.when(k % 5 == 1, word(V.PROCESSES)).alias("process"), F.when(k % 6 == 1, word(V.FUNCTIONS)).alias("function"),
    )


@query(f"WITH a AS ({_ANNOTATED}), b AS (SELECT part, lower(description) || ' ' AS t FROM a) SELECT part, {_keyword_sql('t')} AS category FROM b")
def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select("part", rules.category_by_keywords("description").alias("category"))


@query(f"""WITH a AS ({_ANNOTATED}), c AS (SELECT *, lower(description) || ' ' AS t, {_case_sql('domain', V.DOMAINS)} AS c1, {_case_sql('superfamily', V.SUPERFAMILIES)} AS c2, {_case_sql('process', V.PROCESSES)} AS c3, {_case_sql('function', V.FUNCTIONS)} AS c4 FROM a)
    SELECT part, coalesce(c1, c2, c3, c4, {_keyword_sql('t')}) AS category, CASE WHEN c1 IS NOT NULL THEN 'pfam:' || domain WHEN c2 IS NOT NULL THEN 'superfamily:' || superfamily WHEN c3 IS NOT NULL THEN 'go_bp:' || process WHEN c4 IS NOT NULL THEN 'go_mf:' || function ELSE 'keywords' END AS source FROM c""")
def evidence_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    category, source = rules.category_by_evidence("description", None, "domain", "superfamily", "process", "function")
    return _annotated(spark, sf_dir).select("part", category.alias("category"), source.alias("source"))


@query("""SELECT c_custkey, CASE WHEN x LIKE 'Bacteria%' THEN 'Bacteria' WHEN x LIKE 'Archaea%' THEN 'Archaea' WHEN regexp_matches(x, '[Vv]irus|[Pp]hage') THEN 'Virus' WHEN regexp_matches(x, 'Plant|Viridiplantae') THEN 'Plant'
    WHEN regexp_matches(x, 'Fung|Yeast') THEN 'Fungi' WHEN regexp_matches(x, 'Metazoa|Animal|Mammal|Vertebrat|Insect') THEN 'Animal' ELSE 'Other' END AS domain FROM
    (SELECT c_custkey, ['Bacteria;Proteo', 'Archaea;Eury', 'Eukaryota;Fungi', 'dsDNA virus', 'T7 Phage', 'Eukaryota;Viridiplantae', 'Insecta', 'Eukaryota;Metazoa', 'none'][c_custkey % 9 + 1] AS x FROM customer)""")
def lineage_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Bacteria;Proteo", "Archaea;Eury", "Eukaryota;Fungi", "dsDNA virus", "T7 Phage", "Eukaryota;Viridiplantae", "Insecta", "Eukaryota;Metazoa", "none"]
    x = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("c_custkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.domain_of(x).alias("domain"))


@query("""SELECT c_custkey, coalesce(list_filter(string_split(x, ';'), lambda v: trim(v) <> '')[-1], 'Unclassified') AS leaf FROM
    (SELECT c_custkey, ['Viruses;Duplodnaviria;Heunggongvirae;;', 'Viruses;;;', ';;', '', 'Viruses;Riboviria;Kitrinoviricota'][c_custkey % 5 + 1] AS x FROM customer)""")
def taxonomy_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Viruses;Duplodnaviria;Heunggongvirae;;", "Viruses;;;", ";;", "", "Viruses;Riboviria;Kitrinoviricota"]
    x = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.lowest_rank(x).alias("leaf"))


@query("""SELECT s_suppkey, 'blocks.' || (s_suppkey % 32) || sub AS native, 'decoder.layers.' || (s_suppkey % 32) || CASE sub WHEN '.mlp.l3' THEN '.mlp.linear_fc2' WHEN '.mlp.l1' THEN '.mlp.linear_fc1' ELSE sub END AS service,
    CASE WHEN s_suppkey % 32 = 28 AND sub IN ('.mlp.l3', '.mlp.l1') OR s_suppkey % 32 > 24 THEN 'blocks.20' || sub WHEN s_suppkey % 32 = 14 AND sub = '.mlp.l3' THEN 'blocks.10' || sub ELSE 'blocks.' || (s_suppkey % 32) || sub END AS large
    FROM (SELECT s_suppkey, ['.mlp.l3', '.mlp.l1', '.mixer'][s_suppkey % 3 + 1] AS sub FROM supplier)""")
def layer_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = F.element_at(F.array(F.lit(".mlp.l3"), F.lit(".mlp.l1"), F.lit(".mixer")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    native = F.concat(F.lit("blocks."), (F.col("s_suppkey") % 32).cast("string"), sub)
    return table(spark, sf_dir, "supplier").select("s_suppkey", native.alias("native")).select("s_suppkey", "native", rules.layer_to_service("native").alias("service"), rules.layer_on_large_model("native").alias("large"))


@query("""SELECT s_suppkey, 'ctg_' || (s_suppkey % 9) AS contig, s_suppkey * 3 + 1 AS start, s_suppkey * 3 + 300 AS "end", CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier""")
def prodigal_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.features import orf_header

    k = F.col("s_suppkey")
    header = F.concat_ws(" # ", F.concat(F.lit("ctg_"), (k % 9).cast("string"), F.lit("_"), k.cast("string")), (k * 3 + 1).cast("string"), (k * 3 + 300).cast("string"), F.when(k % 2 == 0, "1").otherwise("-1"), F.lit("ID=1_1;partial=00"))
    parsed = orf_header(header)
    return table(spark, sf_dir, "supplier").select("s_suppkey", parsed["contig_id"].alias("contig"), parsed["start"].alias("start"), parsed["end"].alias("end"), parsed["strand"].alias("strand"))


@query("""SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 600 AS "end", 'region_' || event_id AS name, CAST(least(1000, trunc(value / 60 * 1000)) AS INTEGER) AS score, '.' AS strand FROM events WHERE event_type = 'purchase'""")
def bed_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import bed_score

    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    start = F.unix_timestamp("ts")
    return e.select("user_id", start.alias("start"), (start + 600).alias("end"), F.concat(F.lit("region_"), F.col("event_id").cast("string")).alias("name"), bed_score(F.col("value") / 60).alias("score"), F.lit(".").alias("strand"))


@query("""SELECT lang, '{"lang":"' || lang || '","n":' || count(*) || ',"chars":' || CAST(sum(n_chars) AS BIGINT) || '}' AS summary FROM documents GROUP BY lang""")
def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return by.select("lang", F.to_json(F.struct("lang", "n", "chars")).alias("summary"))

import pytest
from pyspark.sql import functions as F

from helixframe.operators import ml
from helixframe.plans import pipelines as P
from helixframe.sources import fasta, features, provider, sinks
from helixframe.streaming import windows


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta_last_record_wins_in_the_first_place(spark, tmp_path):
    path = write(tmp_path, "a.fasta", ">x first\nacg\nTT\n>y\nAAAA\n>x again\nGG\n")
    marked = write(tmp_path, "m.fasta", ">m a -> b\r\nAC\r\nGT\r\n>n\r\n")
    assert {(r.description, r.sequence) for r in fasta.read_fasta(spark, marked).collect()} == {("m a -> b", "ACGT"), ("n", "")}
    rows = fasta.read_fasta(spark, path).orderBy("seq_ord").collect()
    assert [(r.sequence_id, r.description, r.sequence) for r in rows] == [("x", "x again", "GG"), ("y", "y", "AAAA")]
    assert fasta.read_fasta(spark, path, unique=False).count() == 3
    assert tuple(fasta.alignment_shape(spark, path).first()) == (3, 5)


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 50), ("b", "GG")], "sequence_id string, sequence string")
    sinks.write_fasta(df, str(tmp_path / "out"))
    back = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert {(r.sequence_id, r.sequence) for r in back.collect()} == {("a", "ACGT" * 50), ("b", "GG")}


def test_genomes_are_filtered(spark, tmp_path):
    path = write(tmp_path, "g.fa", ">NC_1 a\nACGU\n>NC_2\nACGR\n>XX_3\nACGT\n")
    assert [(r.sequence_id, r.sequence) for r in fasta.read_genomes(spark, path).collect()] == [("NC_1", "ACGT")]


def test_orf_formats(spark, tmp_path):
    gff = write(tmp_path, "g.gff3", "##gff-version 3\n\nc1\tx\tCDS\t100\t500\t.\t+\t0\tfoo=1\nc1\tx\tgene\t1\t9\t.\t-\t0\tID=g1;x=2\nc1\tx\texon\t1\t9\t.\t-\t0\tID=e1\nshort\tline\n")
    assert {(r.orf_id, r.contig_id, r.start, r.end, r.strand) for r in features.read_orfs(spark, gff).collect()} == {("c1_100_500", "c1", 100, 500, "+"), ("g1", "c1", 1, 9, "-")}
    faa = write(tmp_path, "p.faa", ">c_1_7 # 3 # 90 # -1 # ID=1_7\nMKL\n>c_2_8 # 3\nMM\n")
    assert {(r.orf_id, r.contig_id, r.start, r.end, r.strand, r.protein_sequence) for r in features.read_orfs(spark, faa).collect()} == {("c_1_7", "c_1", 3, 90, "-", "MKL"), ("c_2_8", "c_2", 3, 0, "+", "MM")}
    with pytest.raises(ValueError):
        features.read_orfs(spark, write(tmp_path, "x.txt", "hello\n"))


def test_labels_and_their_numbers(spark, tmp_path):
    df = features.read_labels(spark, write(tmp_path, "l.tsv", "sequence_id \tlabel\na\tviral\nb\tcellular\n"))
    coded, classes = features.encode_labels(df)
    assert classes == ["cellular", "viral"] and {r.sequence_id: r.label for r in coded.collect()} == {"a": 1, "b": 0}
    ints, _ = features.encode_labels(spark.createDataFrame([("a", "3"), ("b", "0")], "sequence_id string, label string"))
    assert {r.label for r in ints.collect()} == {0, 3}


def test_tool_outputs(spark, tmp_path):
    g = features.read_virus_summary(spark, write(tmp_path, "v.tsv", "seq_name\tvirus_score\nc1|provirus_1_9\t0.9\nc2\t0.8\n"))
    assert {(r.sequence_id, r.score) for r in g.collect()} == {("c1", 0.9), ("c2", 0.8)}
    d = features.read_scored_calls(spark, write(tmp_path, "d.tsv", "name\tlen\tscore\tpvalue\na x\t1\t0.9\t0.01\nb\t1\t0.9\t0.5\n"))
    assert {(r.sequence_id, r.is_viral, r.gated) for r in d.collect()} == {("a", True, 0.9), ("b", False, 0.0)}
    s = features.read_split_calls(spark, write(tmp_path, "s.tsv", "seqname\tscore\nq||full\t1\n"))
    assert s.first().sequence_id == "q"
    p = features.read_proviruses(spark, write(tmp_path, "p.tsv", "seq_name\tcoordinates\nz|provirus\t5-10\n"))
    assert tuple(p.first()) == ("z", 5, 10)
    n = features.read_name_list(spark, write(tmp_path, "n.fna", ">k desc\nACGT\n"))
    assert n.first().sequence_id == "k"
    hits = features.read_hits(spark, write(tmp_path, "h.tsv", "\t".join(["q", "t", "0.5", *["1"] * 7, "1e-5", *["1"] * 6, "9", "x"]) + "\n"), "db")
    assert len(hits.columns) == 20 and hits.first().evalue == 1e-5


def test_quality_and_score_tables(spark, tmp_path):
    q = features.read_quality(spark, write(tmp_path, "q.csv", "contig_id,sample,checkv_quality\na,s1,High\nb,s2,Low\n"), "s1")
    assert [(r.sequence_id, r.checkv_quality) for r in q.collect()] == [("a", "High")]
    r = features.read_scores(spark, write(tmp_path, "r.tsv", "contig_id\tviral_score\tclassification\na\t0.5\tviral\nb\tx\t\n")).orderBy("sequence_id").collect()
    assert [(x.sequence_id, x.score) for x in r] == [("a", 0.5), ("b", None)]


def test_structures_and_intervals(spark, tmp_path):
    line = "ATOM      1  N   MET A   1      11.104   6.134  -6.504  1.00 {:5.2f}           N"
    pdb = write(tmp_path, "a_unrelaxed_rank_001_x.pdb", "\n".join([line.format(50), line.format(70), "TER", "ATOM short"]))
    assert features.read_confidence(spark, pdb).first().mean_confidence == 60.0
    assert features.predicted_structures(spark, str(tmp_path)).first().name == "a"
    one = write(tmp_path, "1.json", '{"g": {"exons": [{"start": 1, "end": 5}], "cds": [], "length": 9}}')
    two = write(tmp_path, "2.json", '{"g": {"exons": [], "cds": [], "length": 10}}')
    assert features.read_intervals_json(spark, [one, two]).first().length == 10


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n int")
    assert "<h1>T &amp; x</h1>" in sinks.html_report("T & x", {"n": 1}, {"bars": df})
    assert sinks.markdown_table(df).splitlines()[0] == "| k | n |" and "\\toprule" in sinks.latex_table(df)
    regions = spark.createDataFrame([("c", 1, 5, "r", 0.98765), ("c", 1, 5, "r", 2.0)], "chromosome_id string, start long, end long, region_id string, mean_score double")
    sinks.write_bed(regions, str(tmp_path / "bed"))
    assert {x.value for x in spark.read.text(str(tmp_path / "bed")).collect()} == {"c\t1\t5\tr\t987\t.", "c\t1\t5\tr\t1000\t."}


def seqs(spark, n=12, length=600):
    return spark.createDataFrame([(f"s{i}", ("ACGT"[i % 4] + "ACGGT") * (length // 6 + i)) for i in range(n)], "sequence_id string, sequence string")


def test_cache_computes_only_what_is_missing(spark, tmp_path):
    cache = provider.Cache(spark, str(tmp_path / "cache"), "m-1", "l.2")
    few, many = seqs(spark, 5), seqs(spark, 9)
    assert cache.fill(few, provider.HashProvider(8), "l") == 5
    first = {r.sequence_id: r.embedding for r in cache.read().collect()}
    assert cache.fill(many, provider.HashProvider(8), "l", parts=2) == 4 and cache.fill(many, provider.HashProvider(8), "l") == 0
    assert all({r.sequence_id: r.embedding for r in cache.read().collect()}[k] == v for k, v in first.items())
    cache.compact()
    assert cache.read().count() == 9 and cache.gather(many.select("sequence_id")).count() == 9
    with pytest.raises(Exception, match="no vector of"):
        cache.gather(spark.createDataFrame([("zz",)], "sequence_id string"), strict=True).collect()
    provider.check_size(cache.read(), 8)
    with pytest.raises(ValueError):
        provider.check_size(cache.read(), 9)


def test_providers(spark):
    class Flaky(provider.HashProvider):
        def vectors(self, ids, sequences, layer):
            return [None if i == "bad" else v for i, v in zip(ids, super().vectors(ids, sequences, layer), strict=True)]

    with pytest.raises(ValueError):
        provider.provider("nothing")
    with pytest.raises(NotImplementedError):
        provider.provider("local").vectors([], [], "")
    df = spark.createDataFrame([("bad", "ACGT"), ("ok", "ACG")], "sequence_id string, sequence string").coalesce(1)
    assert [r.sequence_id for r in provider.embed(df, Flaky(4), "l").collect()] == ["ok"]
    with pytest.raises(Exception, match="failed"):
        provider.embed(df.filter("sequence_id = 'bad'"), Flaky(4), "l").count()


@pytest.fixture(scope="module")
def model(spark):
    df = provider.embed(seqs(spark, 40), provider.HashProvider(8), "l").withColumn("y", F.pmod(F.xxhash64("sequence_id"), F.lit(2)).cast("int"))
    return ml.Classifier.fit(df, "embedding", "y", ["cellular", "viral"], kind="forest", trees=5)


def test_detection_end_to_end(spark, model, tmp_path):
    df = spark.createDataFrame([(f"c{i}", "ACGT" * (75 * (i + 3) // 3)) for i in range(10)], "sequence_id string, sequence string")
    out = P.detect(df, provider.HashProvider(8), "l", model, cache=provider.Cache(spark, str(tmp_path), "m", "l"))
    rows = out.collect()
    assert len(rows) == df.filter(F.length("sequence") >= 500).count() and all(0 <= r.viral_score <= 1 for r in rows)
    s = P.detection_summary(out).first()
    assert s.total == len(rows) == s.n_viral + s.n_cellular + s.n_ambiguous
    with pytest.raises(ValueError):
        P.detect(df, provider.HashProvider(8), "l", model, threshold=1.5)
    known = seqs(spark, 60).select("sequence_id", F.when(F.substring("sequence", 1, 1) == "A", 0.95).otherwise(0.05).alias("viral_score"))
    fast = P.detect_fast(seqs(spark, 60), provider.HashProvider(8), "l", model, known)
    assert fast.count() == 60 and fast.filter("phase = 'kmer'").count() > 0


@pytest.mark.parametrize("few", [100, 1])
def test_region_scan(spark, model, few):
    chrom = spark.createDataFrame([("chr", "ACGTTGCAAC" * 3000), ("two", "GATTACA" * 1000)], "sequence_id string, sequence string")
    windows_, regions = P.scan_regions(chrom, provider.HashProvider(8), "l", model, few=few, min_length=1000, coarse_threshold=0.0)
    w = windows_.collect()
    assert w and len({r.window_id for r in w}) == len(w)
    assert all(r.end - r.start >= 1000 and r.n_windows >= 1 for r in regions.collect())


def test_profiles_scans_and_context(spark):
    panel = provider.embed(seqs(spark, 20), provider.HashProvider(8), "l").withColumn("label", F.when(F.pmod(F.xxhash64("sequence_id"), F.lit(2)) == 0, "phage").otherwise("chromosome"))
    prof = P.characterise(provider.embed(seqs(spark, 6), provider.HashProvider(8), "l"), panel).collect()
    assert len(prof) == 6 and all(r.nearest in ("phage", "chromosome") and 0 <= r.anomaly_percentile <= 1 and r.interpretation.viral for r in prof)
    pos = provider.embed_positions(seqs(spark, 2, 300), provider.HashProvider(8), "l")
    genes = spark.createDataFrame([("s0", 11, 200), ("s1", 50, 120)], "sequence_id string, start long, end long")
    scan = P.gene_scan(pos, genes, smooth=20).collect()
    assert len(scan) == 2 and all(0 <= r.accuracy <= 1 and r.coding for r in scan)
    orfs = spark.createDataFrame([("o1", "s0", 30, 400), ("o2", "none", 1, 5)], "orf_id string, contig_id string, start long, end long")
    notes = spark.createDataFrame([("o1", "a function", "1e-3")], "id string, function string, evalue string")
    ctx = P.gene_context(orfs, seqs(spark, 2), provider.HashProvider(8), "l", notes).collect()
    assert [(r.orf_id, r.annotation, r.annotation_score) for r in ctx] == [("o1", "a function", 0.001)] and ctx[0].embedding_norm > 0


def test_reference_building_clusters_and_tools(spark):
    vecs = provider.embed(seqs(spark, 120), provider.HashProvider(6), "l")
    labels = vecs.select("sequence_id", (F.col("embedding")[0] > 0).cast("int").alias("label"))
    model, metrics, bins = P.build_reference(vecs, labels, ["cellular", "viral"], hidden=(6,), iterations=40)
    assert metrics.count() >= 1 and bins.count() >= 1
    assert P.predict(vecs, model).count() == vecs.count()
    out, summary, quality = P.cluster_sequences(vecs, k=3, components=2)
    assert out.count() == vecs.count() and summary.first().n_clusters == 3 and -1 <= quality.first().silhouette <= 1
    truth = spark.createDataFrame([("a", True), ("b", False)], "sequence_id string, t boolean")
    calls = {"x": spark.createDataFrame([("a", True)], "sequence_id string, is_viral boolean")}
    assert P.compare_tools(truth, "t", calls).first().n == 2 and P.compare_tools(truth, "t", calls, missing="skip").first().n == 1


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 {i % 24:02d}:00:00", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string, value double").select("event_id", "user_id", F.to_timestamp("t").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.hopping(stream).writeStream.outputMode("complete").format("memory").queryName("hops").option("checkpointLocation", str(tmp_path / "cp1")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select * from hops").collect()))
    assert got == sorted(map(tuple, windows.hopping(df).collect()))
    for _ in range(2):  # the second run finds nothing new
        windows.ingest(stream, lambda b: b.select("event_id", "value"), "event_id", str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_archives_files_and_coded_regions(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "e.npz", sequence_ids=np.array(["a", "b"]), embeddings=np.ones((2, 3), np.float32))
    assert {(r.sequence_id, tuple(r.embedding)) for r in features.read_npz(spark, str(tmp_path / "e.npz")).collect()} == {("a", (1, 1, 1)), ("b", (1, 1, 1))}
    long = "L" * 45
    ids = spark.createDataFrame([("x/1",), (long + "tail",), ("none",)], "sequence_id string")
    files = spark.createDataFrame([("/d/x_1.npy",), (f"/d/{long}other.npy",), (f"/d/{long}zz.npy",)], "path string")
    assert {r.sequence_id: r.path for r in features.match_files(ids, files).collect()} == {"x/1": "/d/x_1.npy", long + "tail": f"/d/{long}other.npy", "none": None}
    coded = features.coded_by(F.lit("complement(join(AB_1.2:1..3,AB_1.2:<7..>8))"))
    r = spark.range(1).select(coded.alias("c"), features.coding_sequence(F.lit("AACGTTGC"), coded).alias("s")).first()
    assert (r.c.accession, r.c.reverse, [tuple(p) for p in r.c.parts], r.s) == ("AB_1.2", True, [(1, 3), (7, 8)], "GCGTT")


def test_report_pages(spark):
    res = spark.createDataFrame([("a", 500, 0.9, "viral"), ("b", 600, 0.1, "cellular")], "contig_id string, contig_length int, viral_score double, classification string")
    assert "Cumulative share" in sinks.detection_report(res)
    pred = spark.createDataFrame([(1, [0.1, 0.9]), (0, [0.8, 0.2])], "label int, probabilities array<double>")
    assert "Calibration" in sinks.training_report(pred, ["cellular", "viral"])


def test_what_a_provider_cannot_take_is_an_error(spark):
    good = [("a", "ACGT"), ("b", "A" * 16_000)]
    one = provider.provider("hash", size=4)
    assert provider.embed(spark.createDataFrame(good, "sequence_id string, sequence string"), one, "x").count() == 2
    for bad, word in (("A" * 16_001, "longer"), ("", "empty"), (None, "empty")):
        with pytest.raises(Exception, match=f"sequence bad is {word}"):
            provider.embed(spark.createDataFrame([*good, ("bad", bad)], "sequence_id string, sequence string"), one, "x").collect()
    one.alphabet = "ACGTN"
    with pytest.raises(Exception, match="letters other than"):
        provider.embed(spark.createDataFrame([*good, ("bad", "ACGU")], "sequence_id string, sequence string"), one, "x").collect()


def test_positions_are_written_once_and_places_found(spark, tmp_path):
    from helixframe.sources import places

    rows = [(f"s{i}", "ACGTACGT"[: i + 2]) for i in range(5)]
    df = spark.createDataFrame(rows, "sequence_id string, sequence string")
    path, one = str(tmp_path / "positions"), provider.provider("hash", size=3)
    assert provider.write_positions(df.limit(3), one, "x", path) == 3 and provider.write_positions(df, one, "x", path) == 2 and provider.write_positions(df, one, "x", path) == 0
    got = {r.sequence_id: r["count"] for r in spark.read.parquet(path).groupBy("sequence_id").count().collect()}
    assert got == {i: len(s) for i, s in rows}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.npy").write_text("")
    assert places.first_folder(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "*.npy") == str(tmp_path / "b")
    assert places.first_folder(spark, [str(tmp_path / "a")], "*.npy") is None
    assert places.Places("/r").model("m") == "/r/models/m" and places.Places().cache().endswith("/cache")


def test_a_saved_model_keeps_its_calibration(spark, tmp_path):
    import numpy as np

    from helixframe.operators import ml

    rng = np.random.default_rng(3)
    for classes in (["a", "b"], ["a", "b", "c"]):
        data = [(i, (i % len(classes)), (rng.normal(size=4) + i % len(classes)).tolist()) for i in range(240)]
        df = spark.createDataFrame(data, "k int, label int, embedding array<double>")
        model = ml.Classifier.fit(df.filter("k % 4 < 2"), "embedding", "label", classes, kind="forest", trees=5, depth=3).calibrate(df.filter("k % 4 >= 2"), "embedding", "label")
        assert model.calibrators
        model.save(str(tmp_path / str(len(classes))))
        again = ml.Classifier.load(spark, str(tmp_path / str(len(classes))))
        a, b = ([r.probabilities for r in m.probabilities(df, "embedding").orderBy("k").collect()] for m in (model, again))
        assert np.allclose(a, b) and np.allclose(np.sum(a, 1), 1)


def test_large_tables_are_not_cut_in_reports(spark):
    df = spark.range(30).select(F.col("id").alias("k"), F.col("id").alias("n"))
    assert sinks.markdown_table(df, most=30).count("\n") == 31
    for f in (sinks.markdown_table, sinks.latex_table, lambda d, most: sinks.html_report("t", {}, {"x": d}, most)):
        with pytest.raises(ValueError, match="more than 29 rows"):
            f(df, most=29)


def test_vectors_by_prefix_and_zeros(spark):
    from helixframe.operators import lookups as L

    a = spark.createDataFrame([("abc",), ("abd_long",), ("zz",)], "dna string")
    b = spark.createDataFrame([("abcdef", 0, [1.0, 2.0]), ("abd", 1, [3.0, 4.0])], "protein string, o int, v array<double>")
    got = {r.dna: r.v for r in L.matched_vectors(a, b, "dna", "protein", "o", "v", 2).collect()}
    assert got == {"abc": [1.0, 2.0], "abd_long": [3.0, 4.0], "zz": [0.0, 0.0]}
    assert L.matched_vectors(a, b.filter("o = 0"), "dna", "protein", "o", "v", 2) is None


def test_ties_of_labels_and_ordered_passes(spark):
    import random

    from helixframe.operators import metrics as M
    from helixframe.operators import neighbours as N
    from helixframe.operators import ordered, sampling

    sims = spark.createDataFrame([(1, {"plasmid": 0.5, "phage": 0.5, "z": 0.1}), (2, {"b": -1.0})], "k int, similarities map<string,double>")
    assert {r.k: r.nearest for r in N.nearest_label(sims, "k").collect()} == {1: "phage", 2: "b"}
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randrange(50) / 7) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, c string, x double")
    got = {r.value: r.share for r in M.ecdf(df, "x").collect()}
    assert all(abs(share - sum(x <= v for _, _, x in rows) / 700) < 1e-12 for v, share in got.items()) and len(got) == len({x for *_, x in rows})
    ranks = {r.k: (r.c, r.r, r.n) for r in ordered.class_ranks(df, "c", sampling.key_order("k"), sampling.PRIME, "k", "r", "n").collect()}
    for c in "ab":
        mine = sorted((k for k, d, _ in rows if d == c), key=lambda k: ((k % 2**31) * sampling.FACTOR + 42) % sampling.PRIME)
        assert [ranks[k] for k in mine] == [(c, i + 1, len(mine)) for i in range(len(mine))]
    assert M.ecdf(df.filter("false"), "x").count() == 0


def test_annotations_of_a_file_and_of_a_folder(spark, tmp_path):
    for name, row in (("b.tsv", "p2\tx"), ("a.tsv", "p1\ty")):
        (tmp_path / name).write_text(f"query\tfunction\n{row}\n")
    (tmp_path / "0.txt").write_text("no table")
    got = features.read_annotations(spark, str(tmp_path)).collect()
    assert [(r.protein_id, r.function) for r in got] == [("p1", "y")]
    assert features.read_annotations(spark, str(tmp_path / "b.tsv")).first().protein_id == "p2"
    with pytest.raises(FileNotFoundError):
        features.read_annotations(spark, str(tmp_path), "*.xls")

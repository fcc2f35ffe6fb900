import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import rules, seq, vec
from helixframe.operators import blocks, graph, kmers, ml, network
from helixframe.operators import intervals as I
from helixframe.operators import lookups as L
from helixframe.operators import metrics as M
from helixframe.operators import neighbours as N
from helixframe.operators import sampling
from helixframe.operators import signal as S
from helixframe.operators.linear import principal, scaled
from helixframe.operators.peaks import kept_peaks
from helixframe.operators.spectrum import power_spectrum


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


# --- intervals
def test_short_sequence_is_one_window_and_the_last_window_ends_at_the_end(spark):
    df = spark.createDataFrame([("a", 400), ("b", 11000), ("c", 0)], "id string, n long")
    rows = I.tile(df, "id", "n", 5000, 3000).collect()
    assert [(r.start, r.end) for r in rows if r.id == "a"] == [(0, 400)]
    assert [(r.start, r.end) for r in rows if r.id == "b"] == [(0, 5000), (3000, 8000), (6000, 11000)]
    assert not [r for r in rows if r.id == "c"]
    two = spark.createDataFrame([("x", 50_000), ("y", 50_000)], "id string, n long")
    assert I.tile(two, "id", "n", 5000, 2000).count() == 48


def windows(spark, scores, size=5000, step=2000):
    return spark.createDataFrame([("chr", i * step, i * step + size, s) for i, s in enumerate(scores)], "c string, start long, end long, s double")


@pytest.mark.parametrize(
    ("scores", "step", "gap", "least", "want"),
    [
        ([0.9] * 5, 2000, 3000, 0, [(0, 13000)]),
        ([0.9, 0.1, 0.9], 5000, 5000, 0, [(0, 15000)]),
        ([0.9, 0.1, 0.1, 0.9], 5000, 5000, 0, [(0, 5000), (15000, 20000)]),
        ([0.9], 5000, 0, 10000, []),
        ([0.1, 0.2], 5000, 0, 0, []),
    ],
)
def test_regions(spark, scores, step, gap, least, want):
    rows = I.merge_regions(windows(spark, scores, 5000, step), "c", "s", 0.5, gap, least).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == want and [r.region_no for r in rows] == list(range(len(want)))


def test_region_scores_and_nested_windows(spark):
    df = spark.createDataFrame([("c", 0, 100, 0.9), ("c", 10, 20, 0.7), ("c", 95, 120, 0.8)], "c string, start long, end long, s double")
    r = I.merge_regions(df, "c", "s", 0.5, 0).collect()
    assert len(r) == 1 and r[0].n_windows == 3 and r[0].max_score == 0.9 and abs(r[0].mean_score - 0.8) < 1e-9 and r[0].end == 120


def test_candidate_regions_clip_and_touch(spark):
    df = spark.createDataFrame([("c", 0, 100, 1000, 0.9), ("c", 200, 300, 1000, 0.9), ("c", 950, 1000, 1000, 0.9)], "c string, start long, end long, n long, s double")
    rows = I.candidate_regions(df, "c", "n", "s", 0.5, 50).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 350), (900, 1000)]


def test_overlap_join_against_brute_force(spark):
    rng = np.random.default_rng(1)
    mk = lambda n: [(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, n), rng.integers(0, 40_000, n), rng.integers(1, 9000, n))]  # noqa: B905, E731
    a, b = mk(60), mk(60)
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "i int, k int, s long, e long")
    right = spark.createDataFrame([(i, *r) for i, r in enumerate(b)], "j int, k int, bs long, be long")
    got = sorted((r.i, r.j, r.overlap) for r in I.overlap_join(left, right, "k", "s", "e", "bs", "be").collect())
    want = sorted((i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert got == want


def test_coverage_runs_fill_uncovered_stretches(spark):
    t = spark.createDataFrame([("s", 0, 10, 1.0), ("s", 5, 15, 3.0)], "k string, start long, end long, v double")
    n = spark.createDataFrame([("s", 20)], "k string, length long")
    rows = I.coverage_mean(t, "k", "v", n).orderBy("start").collect()
    assert [(r.start, r.end, r.n, r["mean"]) for r in rows] == [(0, 5, 1, 1.0), (5, 10, 2, 2.0), (10, 15, 1, 3.0), (15, 20, 0, 0.0)]


# --- signal
def track(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "s string, i int, x double")


@pytest.mark.parametrize("width", [1, 2, 5, 6, 9])
def test_reflected_moving_average(spark, width):
    x = np.random.default_rng(width).normal(size=23)
    padded = np.pad(x, width, mode="symmetric")
    left = width // 2
    want = [padded[width + i - left : width + i - left + width].mean() for i in range(len(x))]
    got = [r.smooth for r in S.moving_average_reflect(track(spark, x), "s", "i", "x", width).orderBy("i").collect()]
    assert np.allclose(got, want)


@pytest.mark.parametrize("width", [5, 4])
def test_zero_padded_moving_average(spark, width):
    x = np.random.default_rng(width).normal(size=30)
    got = [r.smooth for r in S.moving_average_zero(track(spark, x), "s", "i", "x", width).orderBy("i").collect()]
    assert np.allclose(got, np.convolve(x, np.ones(width) / width, "same"))


def test_merged_peaks_compare_with_the_last_kept_one(spark):
    peaks = spark.createDataFrame([("s", 10, 1.0), ("s", 20, 3.0), ("s", 45, 2.0), ("s", 60, 9.0), ("s", 100, 1.0)], "s string, i int, x double")
    assert S.merge_peaks(peaks, "s", "i", "x", 30).first().peaks == [20, 60, 100]


@pytest.mark.parametrize("block", [16, 40, 1 << 16])
def test_frames_in_blocks_equal_whole_sequences(spark, block):
    rng = np.random.default_rng(block)
    x, y = rng.normal(size=333), rng.normal(size=7)
    df = spark.createDataFrame([("s", 3 * i - 50, float(v)) for i, v in enumerate(x)] + [("t", i, float(v)) for i, v in enumerate(y)] + [("u", 5, 1.0)], "s string, i long, x double")
    of = lambda rows, c: {k: [r[c] for r in sorted((r for r in rows if r.s == k), key=lambda r: r.i)] for k in "stu"}
    for values, mode in ((x, "s"), (y, "t")):
        smooth = of(S.moving_average_zero(df, "s", "i", "x", 5, block=block).collect(), "smooth")[mode]
        assert np.allclose(smooth, np.convolve(values, np.ones(5) / 5, "same"))
        mirrored = of(S.moving_average_reflect(df, "s", "i", "x", 5, block=block).collect(), "smooth")[mode]
        assert np.allclose(mirrored, np.convolve(np.pad(values, 2, mode="symmetric"), np.ones(5) / 5, "valid"))
        steps = of(S.first_difference(df, "s", "i", "x", block=block).collect(), "step")[mode]
        assert np.allclose(steps[:-1], np.abs(np.diff(values))) and steps[-1] is None
        c = values - values.mean()
        lags = {r.s: r for r in S.lag_autocorrelation(df, "s", "i", "x", block=block).collect()}[mode]
        assert np.isclose(lags.lag1, (c[1:] * c[:-1]).sum() / (c * c).sum()) and np.isclose(lags.lag3, (c[3:] * c[:-3]).sum() / (c * c).sum())
        peaks = [r.x for r in S.local_peaks(df, "s", "i", "x", 1.0, block=block).filter(F.col("s") == mode).orderBy("i").collect()]
        assert peaks == [values[i] for i in range(1, len(values) - 1) if values[i] > max(values[i - 1], values[i + 1], values.mean() + values.std())]
        var = of(S.frame_variance(df, "s", "i", "x", 10, block=block).collect(), "frame_var")[mode]
        assert np.allclose(var, [values[max(0, i - 9) : i + 1].var() for i in range(len(values))])
        middle = {r.s: r["median"] for r in S.medians(df, "s", "x").collect()}
        assert np.isclose(middle[mode], np.median(values))


def test_a_single_sequence_is_spread_over_tasks(spark):
    df = spark.range(40_000).select((F.col("id") % 1).alias("s"), F.col("id").alias("i"), F.rand(3).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions are joined otherwise
    try:
        parts = S.moving_average_zero(df, "s", "i", "x", 5, block=1000).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("smooth").alias("count"), F.sum("smooth")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 40_000


@pytest.mark.parametrize("width", [30, 64, 1 << 20])
def test_peaks_merged_in_blocks_equal_one_fold(spark, width):
    rng = np.random.default_rng(1)
    rows = [("a", int(p), float(v)) for p, v in zip(np.sort(rng.choice(3000, 700, replace=False)), rng.integers(0, 6, 700), strict=True)]
    rows += [("b", int(p), float(v)) for p, v in zip(np.sort(rng.choice(40_000, 300, replace=False)), rng.random(300), strict=True)] + [("c", 7, 1.0)]
    rows += [("d", 29 + 30 * k, float(10 - k)) for k in range(5)] + [("d", 30 * k, 0.5) for k in range(1, 5)]
    want = set()
    for s in "abcd":
        kept = []
        for _, p, v in sorted(r for r in rows if r[0] == s):
            if kept and p - kept[-1][0] < 30:
                kept[-1] = (p, v) if v > kept[-1][1] else kept[-1]
            else:
                kept.append((p, v))
        want |= {(s, p) for p, _ in kept}
    got = kept_peaks(spark.createDataFrame(rows, "s string, i long, x double"), "s", "i", "x", 30, width).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_spectrum_in_columns_and_rows_equals_one_transform(spark):
    rng = np.random.default_rng(6)
    sizes = {"a": 1009, "b": 512, "c": 3, "d": 2, "e": 4, "f": 1}
    data = {k: rng.normal(size=n) + np.cos(np.arange(n) * 2 * np.pi / 3) for k, n in sizes.items()}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "s string, i long, x double")
    got = {}
    for r in power_spectrum(df, "s", "i", "x", short=1, tile=4).collect():
        got.setdefault(r.s, {})[r.k] = r.power
    for k, x in data.items():
        want = np.abs(np.fft.rfft(x - x.mean())) ** 2
        assert np.allclose([got[k][i] for i in range(len(want))], want, atol=1e-9) and len(got[k]) == len(want)
    whole = {r.s: (r.period, r.third_rank) for r in S.dominant_period(df, "s", "i", "x").collect()}
    parts = {r.s: (r.period, r.third_rank) for r in S.dominant_period(df, "s", "i", "x", short=1, tile=8).collect()}
    assert whole == parts and whole["f"] == (None, None)


def test_spectrum_of_a_million_positions(spark):
    n = 1_000_003
    df = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("i"), (F.cos(F.col("id") * 2 * np.pi / 3) + F.pmod(F.col("id") * 7919, F.lit(1013)) / 1013).alias("x"))
    i = np.arange(n)
    x = np.cos(i * 2 * np.pi / 3) + (i * 7919 % 1013) / 1013
    want = np.abs(np.fft.rfft(x - x.mean())) ** 2
    got = power_spectrum(df, "s", "i", "x").toPandas().sort_values("k")["power"].to_numpy()
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6 * want.max())


def test_third_of_the_spectrum(spark):
    x = np.tile([1.0, 0, 0], 30) + np.random.default_rng(2).normal(0, 0.01, 90)
    r = S.power_at(track(spark, x), "s", "i", "x", 3).first()
    spectrum = np.abs(np.fft.rfft(x - x.mean())) ** 2
    assert np.isclose(r.power, spectrum[30]) and np.isclose(r.share, spectrum[30] / spectrum.sum(), atol=1e-3)
    d = S.dominant_period(track(spark, x), "s", "i", "x").first()
    assert np.isclose(d.period, 3) and d.third_rank == 1


# --- metrics
def test_calibration_error_at_its_extremes(spark):
    rows = spark.createDataFrame([(1, 1.0), (0, 0.0)] * 10, "t int, p double")
    assert M.calibration_error(rows, "t", "p").first().ece == 0.0
    assert M.calibration_error(rows.withColumn("t", 1 - F.col("t")), "t", "p").first().ece == 1.0


def test_bin_edges_are_the_literal_ones(spark):
    rows = spark.createDataFrame([(1, 0.3), (1, 0.6), (1, 0.7), (1, 1.0)], "t int, p double")
    assert {r.bin for r in M.calibration_bins(rows, "t", "p").collect()} == {2, 5, 6, 9}


def test_auc_with_ties_and_a_single_class(spark):
    rng = np.random.default_rng(3)
    t, s = rng.integers(0, 2, 200).astype(bool), rng.integers(0, 12, 200) / 12
    pos, neg = s[t], s[~t]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(t, s)], "t boolean, s double")  # noqa: B905
    assert np.isclose(M.roc_auc(df, "t", "s").first().auc, want)
    assert M.roc_auc(df.filter("t"), "t", "s").first().auc is None


def test_undefined_ratios_are_zero_or_null(spark):
    df = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    assert M.binary_metrics(df, "t", "p").first().precision == 0.0
    assert M.binary_metrics(df, "t", "p", undefined=None).first().f1 is None


def test_known_confusion(spark):
    cells = [(True, True, 97), (False, True, 5), (False, False, 95), (True, False, 3)]
    df = spark.createDataFrame([(t, p) for t, p, n in cells for _ in range(n)], "t boolean, p boolean")
    r = M.binary_metrics(df, "t", "p").first()
    assert (r.accuracy, round(r.precision, 3), r.recall, round(r.f1, 4)) == (0.96, 0.951, 0.97, 0.9604)


# --- rules and sequences
def category(spark, text, gene=None):
    return one(spark, c=rules.category_by_keywords(F.lit(text), F.lit(gene))).c


@pytest.mark.parametrize(
    ("text", "gene", "want"),
    [
        ("Polymerase inhibitor", None, "host_interaction"), ("DNA polymerase", None, "replication"), ("unnamed", "endolysin", "lysis"), ("Major CAPSID protein", None, "structural"),
        ("host nuclease", None, "host_interaction"), ("hypothetical protein", None, "unknown"), ("", None, "unknown"), ("Terminase large subunit", None, "packaging"), ("holin", None, "lysis"),
        ("serine protease", None, "protease"), ("receptor binding", None, "entry"), ("cell-to-cell", None, "movement"),
    ],
)
def test_keywords(spark, text, gene, want):
    assert category(spark, text, gene) == want


def test_evidence_goes_before_keywords(spark):
    lit = lambda x: F.lit(x).cast("string")
    c, s = rules.category_by_evidence(lit("polymerase"), None, lit("Major capsid protein"), lit(None), lit(None), lit(None))
    r = one(spark, c=c, s=s)
    assert (r.c, r.s) == ("structural", "pfam:Major capsid protein")
    c, s = rules.category_by_evidence(lit("polymerase"), None, lit("no such domain"), lit(None), lit("DNA repair"), lit(None))
    assert tuple(one(spark, c=c, s=s)) == ("nuclease", "go_bp:DNA repair")


def test_layer_names(spark):
    for native, service in (("blocks.28.mlp.l3", "decoder.layers.28.mlp.linear_fc2"), ("blocks.3.mixer", "decoder.layers.3.mixer"), ("output_layer", "output_layer")):
        assert one(spark, c=rules.layer_to_service(F.lit(native))).c == service
        assert one(spark, c=rules.layer_to_native(F.lit(service))).c == native
    with pytest.raises(Exception, match="unknown layer"):
        one(spark, c=rules.layer_to_service(F.lit("layer 3")))
    for name, want in (("blocks.28.mlp.l3", "blocks.20.mlp.l3"), ("blocks.30.mixer", "blocks.20.mixer"), ("blocks.10.mlp.l3", "blocks.10.mlp.l3"), ("embedding", "embedding")):
        assert one(spark, c=rules.layer_on_large_model(F.lit(name))).c == want


def test_class_decisions(spark):
    classes = ["chromosome", "plasmid", "phage", "rna_virus"]
    got = [one(spark, c=rules.class_of(F.array(*(F.lit(x) for x in p)), classes, 0.6)).c for p in ([0.1, 0.1, 0.3, 0.5], [0.2, 0.6, 0.1, 0.1], [0.3, 0.2, 0.3, 0.2])]
    assert got == ["rna_virus", "plasmid", "ambiguous"]
    assert one(spark, c=rules.class_of(F.array(F.lit(0.2), F.lit(0.8)), ["cellular", "viral"])).c == "viral"


def test_sequences(spark):
    r = one(spark, rc=seq.reverse_complement(F.lit("AACGTN")), gc=seq.gc_fraction(F.lit("GGCA")), e=seq.gc_fraction(F.lit("")), w=seq.wrap(F.lit("A" * 170)), w2=seq.wrap(F.lit("A" * 160)), sub=seq.slice_of(F.lit("ABCDE"), F.lit(1), F.lit(3)), n=seq.resolve_n(F.lit("ANNA"), F.lit("k")), safe=seq.safe_name(F.lit("a/b")))
    assert (r.rc, r.gc, r.e, r.sub, r.safe) == ("NACGTT", 0.75, 0.0, "BC", "a_b")
    assert r.w == "A" * 80 + "\n" + "A" * 80 + "\n" + "A" * 10 and r.w2.count("\n") == 1
    assert len(r.n) == 4 and set(r.n) <= set("ACGT")


def test_byte_tokens_of_a_long_text_take_time_by_its_length(spark):
    text = "é\n\x00€😀z" * 20_000  # 240,000 bytes; each byte once encoded the whole text again
    begun = time.monotonic()
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string").select("t", seq.byte_tokens("t").alias("b")).collect()
    assert time.monotonic() - begun < 20
    assert [r.b for r in rows] == [list(text.encode()), [], None]


def test_kmer_features():
    f = kmers.features("AAAA")
    assert f[0] == 1.0 and f[64] == 1.0 and f[80] == 0 and f[81] == 0
    g = kmers.features("ACGN")
    assert g[kmers.TRIMERS.index("ACG")] == 0.5 and np.isclose(g[80], 0.5) and g[:64].sum() == 0.5
    assert not kmers.features("").any()


# --- neighbours, clusters, lookups, samples
def vectors(spark, x, labels=None):
    return spark.createDataFrame([(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")


def test_knn_in_blocks_equals_brute_force(spark):
    x = np.random.default_rng(4).normal(size=(90, 6))
    df = vectors(spark, x)
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in N.knn(df, df, 3, skip_self=True, block=25).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 9)
    want = np.argsort(d, axis=1)[:, :3]
    assert all(got[(i, k + 1)] == want[i, k] for i in range(90) for k in range(3))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("skip", [False, True])
def test_knn_by_pivots_equals_all_pairs(spark, metric, skip):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(12, 5)) * 30
    x = np.vstack([middle[rng.integers(0, 12, 260)] + rng.normal(size=(260, 5)), np.zeros((4, 5)), np.repeat(rng.normal(size=(1, 5)), 30, 0)])
    df = vectors(spark, x)
    queries, panel = df.filter("vec_id % 3 <> 1"), df.filter("vec_id % 4 <> 2")
    k = 6
    found = N.knn(queries, panel, k, metric, skip_self=skip, block=40, pivots=15).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    q, p = [i for i in range(len(x)) if i % 3 != 1], [i for i in range(len(x)) if i % 4 != 2]
    d = 1 - u @ u.T if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.neighbour_id, r.distance)
    assert sorted(got) == q
    for i in q:
        want = sorted((round(d[i, j], 9) + 0.0, j) for j in p if not (skip and i == j))[:k]
        own = [got[i][r] for r in range(1, k + 1)]
        assert [round(x, 9) + 0.0 for _, x in own] == [w[0] for w in want]
        assert len({j for j, _ in own}) == k
    twins = [i for i in q if i >= 264]  # thirty equal vectors: the smallest ids
    least = [j for j in p if j >= 264]
    for i in twins:
        assert [got[i][r][0] for r in range(1, k + 1)] == [j for j in least if not (skip and i == j)][:k]


def test_knn_visits_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(10)
    middle = rng.normal(size=(150, 16)) * 10
    x = middle[rng.integers(0, 150, 4000)] + rng.normal(size=(4000, 16)) * 0.1
    df = vectors(spark, x)
    n = df.count()
    total = N.knn_visits(df, df, 5, "euclidean", skip_self=True, pivots=200).selectExpr("sum(rows) AS rows", "avg(cells) AS cells").first()
    assert total.rows < n**1.5 and total.cells < 4  # of 200 cells; all pairs are 16,000,000


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_of_vectors_in_all_directions_tells_no_row_for_each_cell(spark, metric):
    x = np.random.default_rng(11).normal(size=(900, 32))
    x[500:540] = x[500]  # copies, whose ties go to the smaller ids
    df = vectors(spark, x).withColumn("embedding", F.col("embedding").cast("array<float>"))
    y = x.astype(np.float32).astype(float)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    d = 1 - u @ u.T if metric == "cosine" else np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(900), d.shape), np.round(d, 9)), axis=1)[:, :7]
    found = N.knn(df, df, 7, metric, skip_self=True).collect()
    assert len(found) == 900 * 7 and all(want[r.query_id, r["rank"] - 1] == r.neighbour_id for r in found)
    assert N.knn_visits(df, df, 7, metric, skip_self=True).selectExpr("max(cells)").first()[0] < 5  # of 30


def test_packed_rows_hold_every_vector_once(spark):
    df = spark.range(9000).selectExpr("id", "id % 3 AS l", "array(cast(id AS float), 0.5f) AS v")
    rows = blocks.packed(df, "v", 2).collect()
    assert len(rows) <= 6 and max(len(r.id) for r in rows) <= blocks.PACK and {r["at"] for r in rows} == {0, 1}
    got = {i: (label, tuple(v)) for r in rows for i, label, v in zip(r.id, r.l, np.frombuffer(r.v, "<f4").reshape(-1, 2), strict=True)}
    assert got == {i: (i % 3, (i, 0.5)) for i in range(9000)}


def test_knn_of_empty_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.neighbour_id) for r in N.knn(df, df, 4, skip_self=True).orderBy("query_id").collect()] == [(1, 3), (3, 1)]
    assert N.knn(df, df.limit(0), 4).count() == 0 and N.knn(df.limit(0), df, 4).count() == 0


def clusterable():
    rng = np.random.RandomState(42)
    return np.vstack([rng.normal(c, 0.5, size=(10, 8)) for c in (0, 10, 20)]), np.repeat([0, 1, 2], 10)


def test_clusterings_find_three_groups(spark):
    x, y = clusterable()
    df = vectors(spark, x)
    for found in (ml.density_clusters(df, "vec_id", "embedding", 4), ml.kmeans(df, "embedding", 3, starts=3), ml.communities(N.neighbour_graph(df, 9))):
        rows = found.withColumnRenamed("node", "vec_id").select("vec_id", "cluster").collect()
        groups = {}
        for r in rows:
            groups.setdefault(int(y[r.vec_id]), set()).add(r.cluster)
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3
    assert ml.estimate_k(df, "embedding", most=5) in (2, 3)


def test_silhouettes_equal_the_definition(spark):
    x, y = clusterable()
    df = vectors(spark, x, y)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for r in N.silhouette_euclidean(df, "vec_id", "label", "embedding", block=7).collect():
        own = [j for j in range(30) if y[j] == y[r.vec_id] and j != r.vec_id]
        a = d[r.vec_id, own].mean()
        b = min(d[r.vec_id, y == c].mean() for c in range(3) if c != y[r.vec_id])
        assert np.isclose(r.silhouette, (b - a) / max(a, b))


def test_cluster_summary_and_renumbering(spark):
    s = N.cluster_summary(spark.createDataFrame([(c,) for c in (0, 0, 0, 1, 1, -1, -1)], "c int"), "c").first()
    assert (s.n_clusters, s.n_noise, s.largest, s.smallest) == (2, 2, 3, 2)
    df = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, -1, 10, 10, 10, -1, 3])], "i int, c int")
    assert [r.c for r in L.renumber(df, "c").orderBy("i").collect()] == [1, 1, -1, 2, 2, 2, -1, 0]


def test_last_value_stands_in_the_first_place(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "o int, k string, v int")
    assert [tuple(r) for r in L.last_wins(df, "k", "o").orderBy("o").collect()] == [(0, "a", 3), (1, "b", 2)]


def test_set_overlap(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert tuple(L.set_overlap(ids(*range(10)), ids(1, 2, 3), ids(3, 4), "k").first()) == (1, 2, 1, 6)


def test_samples_are_repeatable_and_filled_up(spark):
    df = spark.createDataFrame([(i, "small" if i < 5 else "large") for i in range(100)], "k long, s string")
    rows = sampling.stratified(df, "s", 30, "k").collect()
    assert len(rows) == 30 and sum(r.s == "small" for r in rows) == 5
    assert sorted(r.k for r in rows) == sorted(r.k for r in sampling.stratified(df.repartition(7), "s", 30, "k").collect())
    assert {r.s: r["count"] for r in sampling.balance(df, "s", "k").groupBy("s").count().collect()} == {"small": 5, "large": 5}
    parts = {r.part: r["count"] for r in sampling.split(df, "s", "k").groupBy("part").count().collect()}
    assert parts == {"train": 80, "calibration": 11, "test": 9} or parts["train"] == 80
    frag = sampling.fragments(spark.createDataFrame([("a", "ACGT" * 600), ("b", "N" * 3000)], "id string, s string"), "id", "s").collect()
    assert len(frag) == 3 + 2 + 2 and all(len(r.fragment) == r.size for r in frag)


def test_prefix_join(spark):
    a = spark.createDataFrame([("gene1",), ("gene22x",), ("gen",), ("other",)], "a string")
    b = spark.createDataFrame([("gene1", 0), ("gene22", 1), ("gene", 2)], "b string, o int")
    got = {r.a: (r.b, r.match) for r in L.prefix_join(a, b, "a", "b", "o").collect()}
    assert got == {"gene1": ("gene1", "exact"), "gene22x": ("gene22", "prefix"), "gen": ("gene1", "prefix"), "other": (None, "none")}


def test_pca_keeps_the_variance(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6)) + rng.normal(0, 1e-3, (80, 6)) + 5
    got = ml.pca(vectors(spark, x), "embedding").orderBy("vec_id").collect()
    z = np.array([r.reduced for r in got])
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert z.shape[1] == 2 and np.allclose(np.abs(z), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_components_of_8192_dimensions(spark):
    rng = np.random.default_rng(12)
    n, d = 300, 8192
    x = rng.normal(size=(n, 12)) * 2.0 ** -np.arange(12) @ rng.normal(size=(12, d)) + rng.normal(0, 0.02, (n, d)) + 3
    df = vectors(spark, x).repartition(7)
    mean, parts, shares = principal(df, "embedding", 10, over=10)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(shares, (s**2 / (s**2).sum())[:10], atol=1e-3)
    assert np.allclose(np.abs(np.diag(v[:8] @ parts[:, :8])), 1, atol=1e-3) and np.allclose(parts.T @ parts, np.eye(10), atol=1e-9)
    got = ml.pca(df, "embedding", 4).orderBy("vec_id").collect()
    assert np.allclose(np.abs([r.reduced for r in got]), np.abs((u * s)[:, :4]), rtol=1e-2, atol=1e-2)


def test_scaling_sums_once_and_keeps_nulls(spark):
    x = np.random.default_rng(13).normal(size=(50, 3)) * [1, 0, 7] + 1e6
    df = vectors(spark, x).repartition(5).unionByName(spark.createDataFrame([(99, None, 0)], "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: r.z for r in scaled(df, "embedding", "z").collect()}
    sd = x.std(0)
    assert got.pop(99) is None and np.allclose([got[i] for i in range(50)], (x - x.mean(0)) / np.where(sd > 0, sd, 1), atol=1e-6)
    assert scaled(df.limit(0), "embedding", "z").count() == 0


def clique_edges(groups, bridges):
    return [(a, b, 1.0) for g in groups for a in g for b in g if a < b] + [(a, b, 0.3) for a, b in bridges]


def test_communities_are_connected_and_as_good_as_the_planted_ones(spark):
    rng = np.random.default_rng(14)
    groups = [list(range(8 * i, 8 * i + 8)) for i in range(9)]
    bridges = [(8 * i + 7, 8 * i + 8) for i in range(8)] + [tuple(sorted(rng.choice(72, 2, replace=False).tolist())) for _ in range(10)]
    edges = spark.createDataFrame(clique_edges(groups, bridges), "src long, dst long, weight double")
    found = graph.communities(edges)
    planted = spark.createDataFrame([(n, i) for i, g in enumerate(groups) for n in g], "node long, cluster long")
    assert graph.modularity(edges, found) >= graph.modularity(edges, planted) - 1e-9
    at = {r.node: r.cluster for r in found.collect()}
    inside = spark.createDataFrame([(a, b) for a, b, _ in clique_edges(groups, bridges) if at[a] == at[b]], "u long, v long")
    parts = {r.node: r.root for r in graph.components(inside).collect()}
    assert len({(at[n], parts.get(n, n)) for n in at}) == len(set(at.values()))


def test_communities_that_fall_apart_are_split(spark):
    links = graph.both_ways(spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0), (2, 5, 1.0)], "src long, dst long, weight double"))
    where = spark.createDataFrame([(i, 7) for i in (1, 2, 3, 4)] + [(5, 8)], "n long, c long")
    assert {r.n: r.c for r in graph.connected(links, where).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_a_turn_of_communities_meets_the_links_once_and_tells_the_modularity(spark):
    rng = np.random.default_rng(21)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (120, 2))})  # some are loops, weights tie
    df = spark.createDataFrame([(a, b, float(1 + (a + b) % 2)) for a, b in edges], "src long, dst long, weight double")
    w = {(r.src, r.dst): r.w for r in graph.both_ways(df).collect()}
    total, nodes = sum(w.values()), sorted({a for a, _ in w}) + [99]  # 99 has a loop only
    w[99, 99] = 3.0
    total += 3.0
    k = {n: sum(x for (a, _), x in w.items() if a == n) for n in nodes}
    at = {n: nodes[n % 7] for n in nodes}
    mass = {c: sum(k[n] for n in nodes if at[n] == c) for c in set(at.values())}
    want = {}
    for n in nodes:
        to = {c: sum(x for (a, b), x in w.items() if a == n != b and at[b] == c) for c in {at[n]} | {at[b] for a, b in w if a == n != b}}
        gain = {c: round(x - k[n] * (mass[c] - (k[n] if c == at[n] else 0.0)) / total, 9) for c, x in to.items()}
        want[n] = (max(gain, key=lambda c: (gain[c], c == at[n], -c)), to[at[n]] + w.get((n, n), 0.0))
    links = spark.createDataFrame([(a, b, x) for (a, b), x in w.items() if a != b], "src long, dst long, w double").repartition(3, "src").persist()
    where = spark.createDataFrame([(n, k[n], w.get((n, n), 0.0), at[n]) for n in nodes], "n long, k double, loop double, c long")
    known = graph.options(links, where, total, 3)
    assert {r.n: (r.best, round(r.inside, 6)) for r in known.collect()} == {n: (c, round(x, 6)) for n, (c, x) in want.items()}
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and len([x for x in plan.splitlines() if "Join" in x and "src#" in x]) == 1
    links.unpersist()
    both = [(a, b, x / 2) for (a, b), x in w.items()]  # each is taken in both directions
    members = spark.createDataFrame(list(at.items()), "node long, cluster long")
    assert np.isclose(graph._quality(known, total), graph.modularity(spark.createDataFrame(both, "src long, dst long, weight double"), members))


def test_graph_components_and_modularity_by_hand(spark):
    rng = np.random.default_rng(15)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    want = {x: x for p in pairs for x in p}
    for _ in range(len(want)):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()} == want
    edges = [(1, 2, 2.0), (2, 3, 1.0), (3, 4, 3.0), (1, 3, 0.5)]
    at, m = {1: 0, 2: 0, 3: 1, 4: 1}, 6.5
    k = {n: sum(w for a, b, w in edges if n in (a, b)) for n in at}
    q = sum(w for a, b, w in edges if at[a] == at[b]) / m - sum((k[a] / (2 * m)) * (k[b] / (2 * m)) for a in at for b in at if at[a] == at[b])
    members = spark.createDataFrame(list(at.items()), "node long, cluster long")
    assert np.isclose(graph.modularity(spark.createDataFrame(edges, "src long, dst long, weight double"), members), q)


def test_classifier_trains_calibrates_and_comes_back(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(-1, 1, (150, 5)), rng.normal(1, 1, (150, 5))])
    df = vectors(spark, x, np.repeat([0, 1], 150))
    model, held = ml.train_and_evaluate(df, "vec_id", "embedding", "label", ["cellular", "viral"], hidden=(8,), iterations=60)
    acc = held.select(F.avg((vec.first_argmax("probabilities") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.85
    forest = ml.Classifier.fit(df, "embedding", "label", ["cellular", "viral"], kind="forest", trees=5)
    forest.save(str(tmp_path / "m"))
    back = ml.Classifier.load(spark, str(tmp_path / "m"))
    a, b = (sorted(tuple(r.probabilities) for r in m.probabilities(df, "embedding").collect()) for m in (forest, back))
    assert a == b and back.classes == ["cellular", "viral"] and len(ml.importances(back, "abcde")) == 5
    ci = {r.metric: r for r in ml.bootstrap(held.withColumn("t", F.col("label") == 1), F.col("t"), vec.first_argmax("probabilities") == 1).collect()}
    assert ci["accuracy"].low <= ci["accuracy"].value <= ci["accuracy"].high


def test_gradients_of_a_network_equal_differences():
    rng = np.random.default_rng(21)
    layers = network.start_layers([4, 6, 5, 3], rng)
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 3, 30)

    def loss(ls):
        p = network.forward(ls, x)[-1]
        return -np.log(p[np.arange(30), y]).mean() + 0.3 / 30 * sum((w**2).sum() for w in ls[::2]) / 2

    for i, g in enumerate(network.gradients(layers, x, y, 0.3)):
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 5)]:
            moved = [a.copy() for a in layers]
            moved[i][at] += 1e-6
            back = [a.copy() for a in layers]
            back[i][at] -= 1e-6
            assert np.isclose((loss(moved) - loss(back)) / 2e-6, g[at], atol=1e-6)


def rings(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    angle, far = rng.uniform(0, 2 * np.pi, n), 1 + y + rng.normal(0, 0.15, n)
    return np.stack([np.cos(angle) * far, np.sin(angle) * far, rng.normal(size=n)], 1), y


@pytest.mark.parametrize("partitions", [1, 3])
def test_a_network_learns_rings_stops_early_and_comes_back(spark, tmp_path, partitions):
    x, y = rings(1800, 1)
    net = network.Network.fit(vectors(spark, x, y), "embedding", "label", 2, (16, 8), epochs=60, batch=50, rate=0.01, patience=5, partitions=partitions)
    assert len(net.losses) <= 61 and min(net.losses) < 0.2 < net.losses[0] and net.sizes == [3, 16, 8, 2]
    tx, ty = rings(600, 2)
    test = vectors(spark, tx, ty).unionByName(spark.createDataFrame([(9999, None, 0)], "vec_id long, embedding array<double>, label int"))
    p = {r.vec_id: r.p for r in net.probabilities(test, "embedding", "p").collect()}
    assert p.pop(9999) is None and np.mean([(p[i][1] > 0.5) == ty[i] for i in range(600)]) > 0.95
    few = network.packed(test, "embedding", "embedding")
    assert {r.vec_id: r.p for r in net.probabilities(few, "embedding", "p", keep=["vec_id"]).collect()} == {**p, 9999: None}
    net.save(str(tmp_path / "net"))
    again = network.Network.load(spark, str(tmp_path / "net"))
    assert again.losses == net.losses and all(np.array_equal(a, b) for a, b in zip(again.layers, net.layers, strict=True))


def test_a_network_without_signal_stops(spark):
    rng = np.random.default_rng(22)
    df = vectors(spark, rng.normal(size=(400, 3)), rng.integers(0, 2, 400))
    net = network.Network.fit(df, "embedding", "label", 2, (8,), epochs=200, batch=40, rate=0.05, patience=3)
    assert len(net.losses) < 60 and min(net.losses) < 0.75
    with pytest.raises(ValueError):
        network.Network.fit(df.limit(0), "embedding", "label", 2)
    assert network.Network.fit(df.limit(2), "embedding", "label", 2, (4,), epochs=2).sizes == [3, 4, 2]


def test_ami_of_equal_and_unrelated_labels(spark):
    from helixframe.operators.panels import adjusted_mutual_information as ami

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 4, (400, 2))], "a int, b int")
    assert abs(ami(df, "a", "b")) < 0.03 and ami(df.withColumn("c", F.col("a") + 7), "a", "c") > 0.999


def test_expected_information_of_small_and_large_overlaps():
    from math import lgamma

    from helixframe.operators.panels import expected_information

    def terms(x, y, n):
        fact = lambda k: lgamma(k + 1)
        k = np.arange(max(1, x + y - n), min(x, y) + 1)
        weight = np.array([fact(x) + fact(y) + fact(n - x) + fact(n - y) - fact(n) - fact(i) - fact(x - i) - fact(y - i) - fact(n - x - y + i) for i in k.tolist()])
        return float((k / n * np.log(n * k / (x * y)) * np.exp(weight)).sum())

    for x, y, n in ((5, 7, 20), (20, 20, 20), (1, 19, 20), (300, 500, 1000), (999, 10, 1000), (3000, 40_000, 60_000), (50_000, 60_000, 100_000), (19_999, 19_999, 200_000)):
        assert abs(float(expected_information(np.array([x]), np.array([y]), n)[0]) - terms(x, y, n)) < 1e-9
    assert 0 < float(expected_information(np.array([5e11]), np.array([6e11]), 10**12)[0]) < 1e-12  # no longer than of few rows


def test_tables_of_analyses(spark):
    from helixframe.operators import tables as T

    panel = spark.createDataFrame([("a", "x", 1), ("b", "noncoding_x", 2), ("c", "y", 3)], "name string, category string, gap int")
    metrics = spark.createDataFrame([("a", 9), ("b", 8)], "name string, gap int")
    sequences = spark.createDataFrame([("a", "GCgcAAAA"), ("z", "G")], "name string, s string")
    got = {r.name: r for r in T.panel_with_metrics(panel, metrics, sequences, "name", "s").collect()}
    assert set(got) == {"a", "b"} and (got["a"].gap, got["a"].gc_content, got["a"].seq_len) == (9, 50.0, 8) and (got["b"].gc_content, got["b"].seq_len) == (0.0, 0)
    meta = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, None), ("q", 1, "z")], "k string, o int, v string")
    chained = T.with_metadata(panel.select("name"), "name", [T.Metadata(meta, "k", {"v": "v", "o2": F.col("o") * 2}, order="o"), T.Metadata(meta, "k", {"w": "v"}, where=F.col("o") == 1)])
    assert {tuple(r) for r in chained.collect()} == {("a", "new", 4, "old"), ("b", None, 2, None), ("c", None, None, None)}
    genes = spark.createDataFrame([("s", 10, 3), ("s", 3, 20), ("t", 5, 5)], "s string, a int, b int")
    assert {r.s: r.boundaries for r in T.boundary_lists(genes, "s", "a", "b").collect()} == {"s": [2, 9, 19], "t": [4]}
    rates = T.rates_by_category(panel, "category", F.col("gap") > 1, order=["y", "x", "none"])
    assert {(r.category, r.n, r.n_hit, r.rate, r.place) for r in rates.collect()} == {("x", 2, 1, 50.0, 2), ("y", 1, 1, 100.0, 1)}
    lengths = spark.createDataFrame([(i,) for i in (499, 500, 999, 1000, 2999, 3000)], "n int")
    assert sorted(tuple(r) for r in T.bin_partition(lengths, "n", [(500, 1000), (1000, 3000)]).collect()) == [(500, "500-1kb"), (999, "500-1kb"), (1000, "1-3kb"), (2999, "1-3kb")]
    x = np.random.default_rng(3).normal(size=(2, 50))
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(x.T)], "s string, i int, c1 double, c3 double")
    track = T.inversion_track(df, "s", "i", "c1", "c3", 10, block=16).orderBy("i").collect()
    same = [np.convolve(v, np.ones(10) / 10, "same") for v in x]
    assert np.allclose([r.c1 for r in track], same[0]) and np.allclose([r.inversion for r in track], same[1] - same[0])


def test_refused_sequences_are_an_error(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "ACXT")], "k string, s string")
    with pytest.raises(Exception, match="sequence b has letters other than ACGT"):
        df.select(seq.checked("s", "k", 10, "ACGT")).collect()
    with pytest.raises(Exception, match="sequence [ab] is longer than 3"):
        df.select(seq.checked("s", "k", 3)).collect()


def test_routing_and_panels(spark):
    from helixframe.operators import panels

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k string")
    assert {r.k: r.source for r in panels.route(ids("a", "b", "c"), [("x", ids("a")), ("y", ids("a", "b"))], "k").collect()} == {"a": "x", "b": "y", "c": "none"}
    df = spark.createDataFrame([("g", "Homo sapiens A", 1), ("g", "Homo sapiens B", 2), ("g", "Mus musculus", 3), ("g", "Rattus rattus", 4)], "g string, o string, i int")
    assert [r.i for r in panels.capped_panel(df, "g", "o", "i", 2).orderBy("i").collect()] == [1, 3]
    got = {r.a: r.b for r in panels.contains_join(ids("ab", "hello world", "zz").withColumnRenamed("k", "a"), spark.createDataFrame([("xxabxx", 1), ("world", 0), ("lo", 2)], "b string, o int"), "a", "b", "o").collect()}
    assert got == {"ab": "xxabxx", "hello world": "world", "zz": None}


def test_whole_texts_are_wrapped(spark, tmp_path):
    import hashlib

    from helixframe.plans import text as plans_text

    rows = [(1, "x" * 170), (2, "a\n" * 200), (3, "y" * 160), (4, "z" * 79 + "\n"), (5, "z" * 80 + "\n"), (6, ""), (7, None), (8, "é\r\n" * 1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.wrapped for r in plans_text.fasta_wrap(spark, str(tmp_path)).collect()}
    want = {i: t if t is None else "\n".join(t[a : a + 80] for a in range(0, len(t), 80)) for i, t in rows}
    assert got == {i: t if t is None else hashlib.md5(t.encode()).hexdigest() for i, t in want.items()}


def test_whole_texts_of_all_languages_are_complemented(spark, tmp_path):
    import hashlib

    from helixframe.plans import text as plans_text

    rows = [(1, "ACGTN" * 100 + "A", "en"), (2, "acgtn x\r\ny", "de"), (3, "GGé\u0301T", None), (4, "", "en"), (5, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.revcomp for r in plans_text.revcomp(spark, str(tmp_path)).collect()}
    up, pairs = str.maketrans("acgtn", "ACGTN"), str.maketrans("ACGTN", "TGCAN")
    assert got == {i: t if t is None else hashlib.md5(t.translate(up).translate(pairs)[::-1].encode()).hexdigest() for i, t, _ in rows}


@pytest.mark.parametrize("normalise", [False, True])
def test_a_network_scores_as_its_library_does(spark, normalise):
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(8)
    data = [(i, i % 3, rng.normal(size=5).tolist(), "x") for i in range(120)] + [(500, 0, [0.0] * 5, "zero")]
    df = spark.createDataFrame(data, "k int, label int, embedding array<double>, `a.b` string")
    model = ml.Classifier.fit(df, "embedding", "label", ["a", "b", "c"], kind="perceptron", hidden=(7, 4), iterations=15, normalise=normalise)
    want = {r.k: r.p for r in model.model.transform(ml.with_features(df, "embedding", normalise=normalise)).select("k", vector_to_array("_p").alias("p")).collect()}
    more = df.unionByName(spark.createDataFrame([(900, 0, None, "null")], df.schema))
    got = model.probabilities(more, "embedding")
    assert got.columns == [*df.columns, "probabilities"]
    rows = {r.k: r.probabilities for r in got.collect()}
    assert rows.pop(900) is None and all(np.allclose(rows[k], p, atol=1e-12) for k, p in want.items()) and len(rows) == len(want)

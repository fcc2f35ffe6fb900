"""Whole analyses as chains of operators: detection, regions, clusters, characterisation, scans, context, training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, vec
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import ml
from ..operators import neighbours as N
from ..operators import signal as S
from ..operators.kmers import kmer_features
from ..operators.lookups import with_parents
from ..sources.provider import Cache, Provider, embed


def _classified(scored: DataFrame, classes: list[str], threshold: float, phase: str) -> DataFrame:
    out = scored.withColumn("viral_score", rules.viral_score("probabilities", classes)).withColumn("classification", rules.class_of("probabilities", classes, threshold))
    if len(classes) > 2:
        out = out.withColumns({f"{c}_score": F.col("probabilities")[i] for i, c in enumerate(classes)})
    return out.withColumn("phase", F.lit(phase)).drop("probabilities")


def detect(sequences: DataFrame, source: Provider, layer: str, model: ml.Classifier, threshold: float = 0.5, min_length: int = 500, cache: Cache | None = None) -> DataFrame:
    """(contig_id, contig_length, viral_score, classification, ...) of sequences that are long enough; the filter stands before the costly step."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    long = sequences.filter(F.length("sequence") >= min_length)
    if cache is not None:
        cache.fill(long, source, layer)
        vectors = cache.gather(long.select("sequence_id"))
    else:
        vectors = embed(long, source, layer)
    scored = model.probabilities(vectors, "embedding").drop("embedding")
    out = _classified(scored, model.classes, threshold, "model")
    lengths = long.select("sequence_id", F.length("sequence").alias("contig_length"))
    return out.join(lengths, "sequence_id").withColumnRenamed("sequence_id", "contig_id")


def detect_fast(sequences: DataFrame, source: Provider | None, layer: str, model: ml.Classifier, labels: DataFrame, threshold: float = 0.5, min_length: int = 500, least: int = 50) -> DataFrame:
    """Detection in two tiers: k-mer features decide what they are sure of, the rest goes to the provider.

    labels: (sequence_id, viral_score) known from before; scores above 0.8 and below 0.2
    train the forest. With fewer than `least` of them all goes the standard way; without
    a provider the k-mer score decides.
    """
    long = sequences.filter(F.length("sequence") >= min_length)
    sure = labels.withColumn("y", rules.pseudo_label("viral_score")).filter("y is not null").select("sequence_id", "y")
    features = kmer_features(long, "sequence_id", "sequence")
    train = features.join(sure, "sequence_id")
    counts = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    if sum(counts.values()) < least or len(counts) < 2:
        if source is None:
            raise ValueError("neither enough known scores nor a provider")
        return detect(sequences, source, layer, model, threshold, min_length)
    forest = ml.Classifier.fit(train, "features", "y", ["cellular", "viral"], kind="forest")
    first = forest.probabilities(features, "features").select("sequence_id", "probabilities").withColumn("tier", rules.triage(F.col("probabilities")[1]))
    border = F.col("tier") == "borderline"
    confident = _classified((first.filter(~border) if source else first).drop("tier"), forest.classes, threshold, "kmer")
    lengths = long.select("sequence_id", F.length("sequence").alias("contig_length"))
    confident = confident.join(lengths, "sequence_id").withColumnRenamed("sequence_id", "contig_id")
    if source is None:
        return confident
    rest = long.join(first.filter(border).select("sequence_id"), "sequence_id", "left_semi")
    columns = ["contig_id", "contig_length", "viral_score", "classification", "phase"]
    return confident.select(columns).unionByName(detect(rest, source, layer, model, threshold, min_length).select(columns))


def detection_summary(result: DataFrame) -> DataFrame:
    """One row of counts and score statistics; ambiguous ones are counted by themselves."""
    c, s = F.col("classification"), F.col("viral_score")
    other = c.isin(*rules.NON_VIRAL)
    return result.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~other & (c != "ambiguous")).alias("n_viral"), F.count_if(other).alias("n_cellular"), F.count_if(c == "ambiguous").alias("n_ambiguous"),
        F.avg(s).alias("mean_score"), F.median(s).alias("median_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
        F.count_if(s >= 0.9).alias("high_confidence"), F.count_if((s >= 0.5) & (s < 0.9)).alias("medium_confidence"), F.count_if(s < 0.5).alias("low_confidence"), F.sum("contig_length").alias("total_bp"),
    )


def _window_scores(windows: DataFrame, source: Provider, layer: str, model: ml.Classifier, key: str) -> DataFrame:
    texts = windows.select(F.col("window_id").alias("sequence_id"), "sequence")
    scored = model.probabilities(embed(texts, source, layer), "embedding").select(F.col("sequence_id").alias("window_id"), rules.viral_score("probabilities", model.classes).alias("viral_score"))
    return windows.drop("sequence").join(scored, "window_id")


def _cut_windows(windows: DataFrame, chromosomes: DataFrame, key: str) -> DataFrame:
    return windows.join(chromosomes.select(key, F.col("sequence").alias("_s")), key).withColumn("sequence", F.col("_s").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("_s")


def scan_regions(chromosomes: DataFrame, source: Provider, layer: str, model: ml.Classifier, key: str = "sequence_id", window: int = 5000, step: int = 2000, threshold: float = 0.5, gap: int = 3000, min_length: int = 5000, coarse: tuple[int, int] = (15_000, 10_000), coarse_threshold: float = 0.3, margin: int = 20_000, few: int = 100) -> tuple[DataFrame, DataFrame]:
    """(windows, regions) of chromosomes: a coarse pass says where the fine one looks, unless there are few windows anyway."""
    window = min(window, source.max_length)
    sized = chromosomes.withColumn("_n", F.length("sequence").cast("long"))
    estimate = sized.agg(F.sum(I.count_windows("_n", window, step))).first()[0] or 0
    if estimate < few:
        windows = I.tile(sized, key, "_n", window, step)
    else:
        size = min(coarse[0], source.max_length)
        first = _window_scores(_cut_windows(I.tile(sized, key, "_n", size, coarse[1]), chromosomes, key), source, layer, model, key)
        regions = I.candidate_regions(first.join(sized.select(key, "_n"), key), key, "_n", "viral_score", coarse_threshold, margin)
        windows = I.tile_regions(regions, sized, key, "_n", window, step)
    scored = _window_scores(_cut_windows(windows, chromosomes, key), source, layer, model, key).withColumn("classification", F.when(F.col("viral_score") >= threshold, "viral").otherwise("cellular"))
    merged = I.merge_regions(scored, key, "viral_score", threshold, gap, min_length)
    return scored, merged.withColumn("region_id", F.concat_ws("_", F.col(key), F.lit("region"), F.col("region_no").cast("string")))


def characterise(vectors: DataFrame, panel: DataFrame, key: str = "sequence_id", label: str = "label", neighbours: int = 10) -> DataFrame:
    """A profile of each vector: nearest category, anomaly, origin ratios and what they mean. panel: (id, label, embedding)."""
    sims = N.centroid_similarities(vectors, key, "embedding", N.centroids(panel, label, "embedding"))
    best = N.nearest_label(sims, key)
    numbered = vectors.select(F.xxhash64(key).alias("vec_id"), key, "embedding")
    reference = panel.select(F.xxhash64(F.struct(panel.columns[0])).alias("vec_id"), "embedding")
    anomaly = N.anomaly_scores(numbered, reference, neighbours)
    own = N.anomaly_scores(reference, reference, neighbours).select(F.col("anomaly").alias("ref"))
    rated = N.strict_percentile(anomaly, own, "anomaly", "ref", "anomaly_percentile").withColumnRenamed("anomaly", "anomaly_score")
    scores = {k: F.round(c, 3) for k, c in rules.origin_scores(F.col("similarities")).items()}
    out = sims.join(best, key).join(numbered.select(key, F.col("vec_id").alias("query_id")), key).join(rated, "query_id").drop("query_id")
    out = out.join(vectors.select(key, vec.norm(vec.as_double("embedding")).alias("embedding_norm")), key).withColumns(scores)
    meaning = F.struct(rules.viral_ladder("viral_signature").alias("viral"), rules.origin_ladder("rna_origin_score").alias("origin"), rules.mobility_ladder("mobile_element_score").alias("mobility"), rules.novelty_ladder("anomaly_percentile").alias("novelty"))
    return out.withColumn("interpretation", meaning)


def position_features(positions: DataFrame, seq: str = "sequence_id", pos: str = "pos", vector: str = "v") -> DataFrame:
    """Periodicity of each sequence: cosine at offsets 1 and 3, autocorrelation of norms at lags 1 and 3, norm statistics, inversion."""
    norms = positions.select(seq, pos, vec.norm(vec.as_double(vector)).alias("norm"))
    cos = S.offset_cosine(positions, seq, pos, vector)
    lags = S.lag_autocorrelation(norms, seq, pos, "norm")
    return cos.join(lags, seq).join(S.norm_stats(positions, seq, vector), seq).withColumn("inversion_gap", F.col("cos3") - F.col("cos1")).withColumn("inverted", F.round("cos3", 4) > F.round("cos1", 4)).withColumn("coding", rules.coding_ladder("lag3"))


def gene_scan(positions: DataFrame, genes: DataFrame, seq: str = "sequence_id", pos: str = "pos", vector: str = "v", smooth: int = 100, within: int = 30, tolerance: int = 50) -> DataFrame:
    """Per sequence: periodicity, how well the norm tells genes from the rest, peaks of its change and how many gene ends they are near. genes: (id, start from 1, end)."""
    spans = genes.select(seq, (F.col("start") - 1).alias("start"), F.col("end"))
    norms = positions.select(seq, pos, vec.norm(vec.as_double(vector)).alias("norm"))
    mask = I.position_mask(norms.select(seq, pos), spans, seq, pos, "coding")
    smoothed = S.moving_average_reflect(norms, seq, pos, "norm", smooth)
    coding = S.above_median(smoothed.join(mask, [seq, pos]), seq, "smooth", "coding")
    change = S.first_difference(smoothed, seq, pos, "smooth")
    peaks = S.merge_peaks(S.local_peaks(change.filter("step is not null"), seq, pos, "step"), seq, pos, "step", within)
    ends = spans.select(seq, F.explode(F.array("start", "end")).alias("boundary")).distinct()
    met = I.near_join(ends, peaks.select(seq, F.explode("peaks").alias("peak")), seq, "boundary", "peak", tolerance).select(seq, "boundary").distinct()
    found = ends.groupBy(seq).agg(F.count(F.lit(1)).alias("n_boundaries")).join(met.groupBy(seq).agg(F.count(F.lit(1)).alias("n_found")), seq, "left")
    rate = found.select(seq, "n_boundaries", F.coalesce("n_found", F.lit(0)).alias("n_found"), (F.coalesce("n_found", F.lit(0)) / F.col("n_boundaries")).alias("boundary_recall"))
    return position_features(positions, seq, pos, vector).join(coding, seq).join(rate, seq, "left").join(S.dominant_period(norms, seq, pos, "norm"), seq).join(peaks.select(seq, F.size("peaks").alias("n_peaks")), seq, "left")


def gene_context(orfs: DataFrame, contigs: DataFrame, source: Provider, layer: str, annotations: DataFrame | None = None, size: int = 2000, least: int = 100) -> DataFrame:
    """Open reading frames of known contigs with the norm of the vector of the window around each (0 without one), and their annotation."""
    known = with_parents(orfs, contigs.select(F.col("sequence_id").alias("contig_id")), "contig_id")
    placed = known.join(contigs.select(F.col("sequence_id").alias("contig_id"), F.col("sequence").alias("_s")), "contig_id")
    start, end = I.centred_window("start", "end", F.length("_s"), size)
    windows = placed.select("orf_id", start.alias("ws"), end.alias("we"), "_s").filter(F.col("we") - F.col("ws") >= least)
    texts = windows.select(F.col("orf_id").alias("sequence_id"), F.col("_s").substr((F.col("ws") + 1).cast("int"), (F.col("we") - F.col("ws")).cast("int")).alias("sequence"))
    norms = embed(texts, source, layer).select(F.col("sequence_id").alias("orf_id"), vec.norm(vec.as_double("embedding")).alias("embedding_norm"))
    out = known.join(norms, "orf_id", "left").withColumn("embedding_norm", F.coalesce("embedding_norm", F.lit(0.0)))
    if annotations is None:
        return out.withColumn("annotation", F.lit(None).cast("string")).withColumn("annotation_score", F.lit(None).cast("double"))
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in annotations.columns], F.lit(None))
    named = annotations.select(F.col(annotations.columns[0]).alias("orf_id"), pick("annotation", "function").cast("string").alias("annotation"), pick("score", "evalue").try_cast("double").alias("annotation_score"))
    return out.join(named.dropDuplicates(["orf_id"]), "orf_id", "left")


def cluster_sequences(vectors: DataFrame, key: str = "sequence_id", method: str = "kmeans", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, summary, silhouette): clustered in the reduced space, judged in the original one."""
    numbered = vectors.select(F.xxhash64(key).alias("vec_id"), key, "embedding")
    found = ml.cluster(numbered, "vec_id", "embedding", method, **options)
    rows = numbered.join(found, "vec_id")
    out = N.assignments(rows, "vec_id", "cluster", "embedding").join(numbered.select("vec_id", key), "vec_id").drop("vec_id")
    quality = N.silhouette_euclidean(rows.filter("cluster >= 0"), "vec_id", "cluster", "embedding").agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))
    return out, N.cluster_summary(rows, "cluster"), quality


def build_reference(vectors: DataFrame, labels: DataFrame, classes: list[str], key: str = "sequence_id", label: str = "label", **fit) -> tuple[ml.Classifier, DataFrame, DataFrame]:
    """(model, per-class metrics, calibration bins) of labelled vectors; labels are class numbers."""
    rows = vectors.join(labels.select(key, F.col(label).cast("int").alias("label")), key)
    model, held = ml.train_and_evaluate(rows, key, "embedding", "label", classes, **fit)
    pred = held.withColumn("pred", vec.first_argmax("probabilities"))
    metrics = M.per_class(pred, "label", "pred")
    bins = M.calibration_bins(pred.withColumn("p", F.col("probabilities")[1]), F.col("label") == 1, "p")
    return model, metrics, bins


def predict(vectors: DataFrame, model: ml.Classifier, key: str = "sequence_id") -> DataFrame:
    """(key, predicted_class, confidence), the first class on a tie."""
    p = model.probabilities(vectors, "embedding")
    names = F.array(*(F.lit(c) for c in model.classes))
    return p.select(key, names[vec.first_argmax("probabilities")].alias("predicted_class"), F.array_max("probabilities").alias("confidence"))


def compare_tools(manifest: DataFrame, truth: str | Column, calls: dict[str, DataFrame], key: str = "sequence_id", missing: str = "negative") -> DataFrame:
    """binary metrics of each tool's calls (key, is_viral); what a tool doesn't name is negative, or (`skip`) isn't counted."""
    out = None
    for name, df in calls.items():
        j = manifest.join(df.select(key, F.col("is_viral").alias("_p")), key, "left" if missing == "negative" else "inner").withColumn("_p", F.coalesce("_p", F.lit(False)))
        m = M.binary_metrics(j, truth, "_p").withColumn("tool", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out

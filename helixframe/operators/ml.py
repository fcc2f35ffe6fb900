"""Models: classifiers with calibration, reduction, clusterings, bootstrap intervals.

Distributed fits use pyspark.ml. What it lacks is built of joins (community
detection, density clusters), of small numpy fits on the driver whose input is a bounded
table (Platt scaling), or of Poisson weights (bootstrap).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec
from . import sampling
from .density import density_clusters as density_clusters  # of this module's methods
from .graph import communities as communities  # of this module's methods
from .linear import pca, scaled
from .neighbours import knn
from .network import Network


def with_features(df: DataFrame, vector: str, out: str = "_features", normalise: bool = False) -> DataFrame:
    v = vec.as_double(vector)
    return df.withColumn(out, array_to_vector(vec.unit(v) if normalise else v))


def network_probabilities(df: DataFrame, vector: str, model: MultilayerPerceptronClassificationModel, normalise: bool, out: str) -> DataFrame:
    """df with a fitted network's probabilities: its layers as matrix products, a batch of rows at a time. A null vector has none."""
    sizes, flat, at, layers = model.getLayers(), model.weights.toArray(), 0, []
    for n, m in zip(sizes, sizes[1:]):  # noqa: B905
        layers.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))  # stored by columns of the m x n matrix
        at += n * m + m
    shared = df.sparkSession.sparkContext.broadcast(layers)  # of the model's size
    place = df.columns.index(vector)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            known = np.asarray(column.is_valid())
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(known.sum()), -1) if known.any() else np.zeros((0, sizes[0]))
            if normalise:
                norms = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norms > 0, norms, 1)
            for i, (w, b) in enumerate(shared.value):
                x = x @ w + b
                if i < len(shared.value) - 1:
                    x = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
            e = np.exp(x - x.max(1, keepdims=True, initial=-np.inf)) if len(x) else x
            p = e / e.sum(1, keepdims=True) if len(x) else e
            ends = np.concatenate([[0], np.cumsum(np.where(known, sizes[-1], 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[f.name for f in schema])

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(each, schema)


#: The row that describes a saved model.
ABOUT = "classes string, normalise boolean, kind string, task string, layer string, calibrators string"


class Classifier:
    """A network, a perceptron of sigmoid layers or a forest on vectors, with optional calibration of its probabilities."""

    def __init__(self, classes: Sequence[str], model, normalise: bool, calibrators: list | None = None, metadata: dict | None = None):
        self.classes, self.model, self.normalise = list(classes), model, normalise
        self.calibrators, self.metadata = calibrators or [], metadata or {}

    @classmethod
    def fit(cls, df: DataFrame, vector: str, label: str, classes: Sequence[str], kind: str = "network", hidden: Sequence[int] = (512, 128), normalise: bool = False, iterations: int = 200, trees: int = 100, depth: int = 10, seed: int = 42, metadata: dict | None = None) -> Classifier:
        rows = with_features(df, vector, normalise=normalise).select("_features", F.col(label).cast("double").alias("_label"))
        if kind == "network":
            columns = df.select((vec.unit(vec.as_double(vector)) if normalise else vec.as_double(vector)).alias("_v"), F.col(label).alias("_label"))
            return cls(classes, Network.fit(columns, "_v", "_label", len(classes), hidden, iterations, seed=seed), normalise, metadata=metadata)
        if kind == "perceptron":
            size = rows.select(F.size(vector_to_array("_features"))).first()[0]
            est = MultilayerPerceptronClassifier(layers=[size, *hidden, max(2, len(classes))], maxIter=iterations, seed=seed, featuresCol="_features", labelCol="_label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred")
        elif kind == "forest":
            est = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="_features", labelCol="_label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred")
        else:
            raise ValueError(f"unknown kind of model: {kind}")
        return cls(classes, est.fit(rows), normalise, metadata=metadata)

    def probabilities(self, df: DataFrame, vector: str, out: str = "probabilities") -> DataFrame:
        if isinstance(self.model, Network):
            scored = self.model.probabilities(df, vector, out, self.normalise)
        elif isinstance(self.model, MultilayerPerceptronClassificationModel):
            scored = network_probabilities(df, vector, self.model, self.normalise, out)
        else:
            scored = self.model.transform(with_features(df, vector, normalise=self.normalise))
            scored = scored.withColumn(out, vector_to_array("_p")).drop("_features", "_p", "_raw", "_pred")
        for step in self.calibrators:
            scored = scored.withColumn(out, calibrated(out, step))
        return scored

    def calibrate(self, df: DataFrame, vector: str, label: str, least: int = 40) -> Classifier:
        """Platt scaling for two classes, isotonic regression one against the rest for more; needs `least` held-out rows."""
        rows = self.probabilities(df, vector).select("probabilities", F.col(label).cast("double").alias("y"))
        if rows.limit(least).count() < least:
            return self
        if len(self.classes) == 2:
            slope, intercept = platt(rows.select(F.col("probabilities")[1].alias("p"), "y"))
            step = {"kind": "sigmoid", "slope": slope, "intercept": intercept}
        else:
            curves = []
            for i in range(len(self.classes)):
                model = IsotonicRegression(featuresCol="p", labelCol="t").fit(rows.select(F.col("probabilities")[i].alias("p"), (F.col("y") == i).cast("double").alias("t")))
                curves.append([[float(x) for x in model.boundaries], [float(y) for y in model.predictions]])
            step = {"kind": "isotonic", "curves": curves}
        return Classifier(self.classes, self.model, self.normalise, [*self.calibrators, step], self.metadata)

    def save(self, path: str) -> None:
        """The model and a row of what else describes it, its calibrators included."""
        if isinstance(self.model, Network):
            self.model.save(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        rows = [(",".join(self.classes), self.normalise, type(self.model).__name__, str(self.metadata.get("task", "")), str(self.metadata.get("layer", "")), json.dumps(self.calibrators))]
        spark.createDataFrame(rows, ABOUT).coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> Classifier:
        about = spark.read.schema(ABOUT).json(f"{path}/about").first()
        kind = {"MultilayerPerceptronClassificationModel": MultilayerPerceptronClassificationModel, "RandomForestClassificationModel": RandomForestClassificationModel, "Network": None}[about.kind]
        return cls(about.classes.split(","), kind.load(f"{path}/model") if kind else Network.load(spark, f"{path}/model"), bool(about.normalise), json.loads(about.calibrators or "[]"), {"task": about.task, "layer": about.layer})


def calibrated(p: str, step: dict) -> Column:
    """Calibrated probabilities by a saved step: a sigmoid on the log-odds of two classes, or a curve for each class, scaled to a sum of 1."""
    if step["kind"] == "sigmoid":
        odds = F.log(F.greatest(F.col(p)[1], F.lit(1e-12)) / F.greatest(1 - F.col(p)[1], F.lit(1e-12)))
        q = 1 / (1 + F.exp(-(F.lit(step["slope"]) * odds + F.lit(step["intercept"]))))
        return F.array(1 - q, q)
    parts = [interpolate(F.col(p)[i], x, y) for i, (x, y) in enumerate(step["curves"])]
    total = sum(parts[1:], parts[0])
    return F.when(total > 0, F.array(*(x / total for x in parts))).otherwise(F.col(p))


def interpolate(x: Column, at: Sequence[float], values: Sequence[float]) -> Column:
    """Piecewise linear, flat beyond the ends."""
    out = F.when(x <= at[0], F.lit(float(values[0])))
    for a, b, u, w in zip(at, at[1:], values, values[1:]):  # noqa: B905
        out = out.when(x <= b, F.lit(float(u)) + (x - a) * ((w - u) / (b - a)) if b > a else F.lit(float(w)))
    return out.otherwise(F.lit(float(values[-1])))


def platt(df: DataFrame, rounds: int = 25, bins: int = 1000) -> tuple[float, float]:
    """Slope and intercept of a logistic curve on the log-odds of p, by Newton steps on a table of at most 2 x bins counts."""
    by = df.select(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("b"), (F.col("y") == 1).cast("int").alias("y"), "p").groupBy("b", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p")).toPandas()
    p = np.clip(by["p"].to_numpy(float), 1e-12, 1 - 1e-12)
    x, n, y = np.log(p / (1 - p)), by["n"].to_numpy(float), by["y"].to_numpy(float)
    pos, neg = n[y == 1].sum(), n[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))  # targets drawn in, so that separable data have a finite fit
    w = np.array([1.0, 0.0])
    feats = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(feats @ w, -35, 35)))
        grad = feats.T @ (n * (q - t))
        hess = (feats * (n * q * (1 - q))[:, None]).T @ feats + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def train_and_evaluate(df: DataFrame, key: str, vector: str, label: str, classes: Sequence[str], **fit) -> tuple[Classifier, DataFrame]:
    """A calibrated model of 80 % of the rows, and the predictions (key, label, probabilities) of the 10 % that neither saw."""
    parts = sampling.split(df, label, key)
    model = Classifier.fit(parts.filter("part = 'train'"), vector, label, classes, **fit)
    model = model.calibrate(parts.filter("part = 'calibration'"), vector, label)
    return model, model.probabilities(parts.filter("part = 'test'"), vector).select(key, label, "probabilities")


def cross_validated(df: DataFrame, key: str, vector: str, label: str, classes: Sequence[str], k: int = 5, **fit) -> DataFrame:
    """(key, label, fold, probabilities): every row predicted by the model that didn't see its fold."""
    parts = sampling.folds(df, label, key, k)
    out = None
    for i in range(k):
        model = Classifier.fit(parts.filter(F.col("fold") != i), vector, label, classes, **fit)
        scored = model.probabilities(parts.filter(F.col("fold") == i), vector).select(key, label, "fold", "probabilities")
        out = scored if out is None else out.unionByName(scored)
    return out


def importances(model: Classifier, names: Sequence[str]) -> list[tuple[str, float]]:
    values = model.model.featureImportances.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def kmeans(df: DataFrame, vector: str, k: int, starts: int = 10, seed: int = 42, out: str = "cluster") -> DataFrame:
    rows = with_features(df, vector)
    held = rows.select("_features").persist()
    try:
        best = min((KMeans(k=k, seed=seed + i, featuresCol="_features", predictionCol=out).fit(held) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    finally:
        held.unpersist()
    return best.transform(rows).drop("_features")


def estimate_k(df: DataFrame, vector: str, most: int = 20, seed: int = 42) -> int:
    """The number of clusters before the largest drop of inertia."""
    rows = with_features(df, vector).cache()
    top = min(most, rows.count() // 3)
    if top < 2:
        return 2
    cost = [KMeans(k=k, seed=seed, featuresCol="_features").fit(rows).summary.trainingCost for k in range(2, top + 1)]
    rows.unpersist()
    drops = [a - b for a, b in zip(cost, cost[1:])]  # noqa: B905
    return 2 + int(np.argmax(drops)) if drops else 2


def bootstrap(df: DataFrame, truth: Column, pred: Column, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, value, low, high): 95 % intervals of accuracy, recall and precision.

    A resample of n rows gives the four cells of the confusion table a multinomial
    count, so the rows are counted once and only the cells are drawn, whatever n is.
    """
    c = df.agg(F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"), F.count_if(~truth & ~pred).alias("tn"), F.count_if(truth & ~pred).alias("fn")).first()
    cells = np.array([c.tp, c.fp, c.tn, c.fn], float)
    n = int(cells.sum())
    draws = np.random.RandomState(seed).multinomial(n, cells / n, rounds).astype(float) if n else np.zeros((0, 4))

    def metrics(x: np.ndarray) -> dict[str, np.ndarray]:
        tp, fp, tn, fn = x.T
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"accuracy": (tp + tn) / x.sum(1), "recall": tp / (tp + fn), "precision": tp / (tp + fp)}

    point, many = metrics(cells[None, :]), metrics(draws)
    num = lambda v: None if np.isnan(v) else float(v)
    rows = []
    for m, v in many.items():
        ok = v[~np.isnan(v)]
        low, high = np.percentile(ok, [2.5, 97.5]) if len(ok) else (np.nan, np.nan)
        rows.append((m, num(point[m][0]), num(low), num(high)))
    return df.sparkSession.createDataFrame(rows, "metric string, value double, low double, high double")


def cluster(df: DataFrame, key: str, vector: str, method: str = "kmeans", k: int | None = None, components: int | None = None, min_size: int = 5, scale: bool = True, seed: int = 42) -> DataFrame:
    """(key, cluster) after scaling and reduction; method: `density`, `kmeans` or `communities`."""
    rows = df.select(key, vec.as_double(vector).alias("_x"))
    if scale:
        rows = scaled(rows, "_x", "_x")
    if components != -1:
        rows = pca(rows, "_x", components).select(key, F.col("reduced").alias("_x"))
    if method == "density":
        return density_clusters(rows, key, "_x", min_size)
    if method == "kmeans":
        return kmeans(rows, "_x", k or estimate_k(rows, "_x", seed=seed), seed=seed).select(key, "cluster")
    if method == "communities":
        near = knn(rows, rows, 15, "euclidean", key, "_x", skip_self=True)
        edges = near.filter("query_id < neighbour_id").select(F.col("query_id").alias("src"), F.col("neighbour_id").alias("dst"), (1 / (1 + F.col("distance"))).alias("weight"))
        found = communities(edges, least=min_size)
        return rows.select(key).join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    raise ValueError(f"unknown method: {method}")

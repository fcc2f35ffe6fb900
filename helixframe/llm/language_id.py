"""Language identification in two levels, with linear support vector machines.

First the family is predicted, one machine against another for each two families, by
votes; then, inside the winning family, the language, again one machine for each two
languages. Features are the shares of hashed byte trigrams of the whole text, so a
prediction costs one pass over it. The machines are trained by dual coordinate
descent on at most `PER_LANGUAGE` labelled texts of each language, which are the ones
whose ids hash lowest.

Predictions use the text alone. A null text and one without any letter are `und`,
with score 0. Rows without an id, or held out, are not learned from. Without any
labelled text everything is `und`, and `keep_identified` keeps every row. Tied votes go
to the greater sum of beliefs, then to the name that sorts first. A very long text is
read whole, in memory proportional to it. Repeated rows are predicted alike. An empty
table gives no rows. `identify` reads no columns but those named; `keep_identified`
returns all, and columns named like its own, in any case, don't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes_np import chunks
from .common import fresh, held_out, numbered, slices, unit_hash

#: Bound of the training sample: texts of each language.
PER_LANGUAGE = 400
BITS = 13
LETTER = re.compile(r"[^\W\d_]")
#: Families of languages by code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def _places(buffer: np.ndarray) -> np.ndarray:
    """The hashed feature of the trigram that starts at each byte but the last two."""
    b = buffer.astype(np.uint32)
    key = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _encoded(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode() + b" "


def trigram_counts(text: str | None) -> np.ndarray:
    return np.bincount(_places(np.frombuffer(_encoded(text), np.uint8)), minlength=1 << BITS)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Weights of a machine with hinge loss, by dual coordinate descent. y: -1 or 1; x has its own constant column."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    square = np.einsum("ij,ij->i", x, x)
    cost = c * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))  # classes count alike
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str, str]]  # (level, a, b); positive margins speak for a
    weights: np.ndarray  # a column for each pair
    constants: np.ndarray
    slopes: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores of rows of margins, one for each pair."""
        sure = 1 / (1 + np.exp(-np.clip(margins * self.slopes, -30, 30)))
        rows = np.arange(len(margins))

        def vote(level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            votes, belief = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
            for k, (at, a, b) in enumerate(self.pairs):
                if at == level:
                    i, j = names.index(a), names.index(b)
                    votes[:, i] += sure[:, k] >= 0.5
                    votes[:, j] += sure[:, k] < 0.5
                    belief[:, i] += sure[:, k]
                    belief[:, j] += 1 - sure[:, k]
            best = np.argmax(votes + belief / (1 + len(names)), axis=1)
            return best, belief[rows, best] / (len(names) - 1) if len(names) > 1 else np.ones(len(margins))

        which, score = vote("", self.families)
        found = np.zeros(len(margins), np.int64)
        for f, name in enumerate(self.families):
            own = [x for x in self.languages if family(x) == name]
            best, inner = vote(name, own)
            here = which == f
            found[here] = np.array([self.languages.index(x) for x in own])[best[here]]
            score = np.where(here, score * inner, score)
        return found, score

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        margins = np.zeros((len(texts), len(self.pairs)))
        for first, buffer, ends in chunks([_encoded(t) for t in texts]):
            places = _places(np.append(buffer, np.uint8(32)))
            starts = np.concatenate([[0], ends[:-1]])
            bounds = np.stack([starts, ends - 3], 1).ravel()  # trigrams inside a text; one at least
            n = (ends - 3 - starts).astype(float)
            for k in range(len(self.pairs)):
                sums = np.add.reduceat(self.weights[:, k][places], bounds)[::2] if len(places) else np.zeros(len(ends))
                margins[first : first + len(ends), k] = np.where(n > 0, sums / np.maximum(n, 1), 0)
        found, score = self.decide(margins + self.constants)
        lettered = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
        return [self.languages[i] if ok else "und" for i, ok in zip(found, lettered, strict=True)], np.where(lettered, score, 0.0)


def fit(counts: np.ndarray, langs: list[str]) -> Model:
    """A model of rows of trigram counts."""
    scale = 100.0
    x = np.empty((len(langs), (1 << BITS) + 1), np.float32)
    x[:, :-1] = counts / np.maximum(counts.sum(1, keepdims=True), 1) * scale
    x[:, -1] = 1
    languages = sorted(set(langs))
    families = sorted({family(x) for x in languages})
    own = np.array(langs)
    groups = np.array([family(x) for x in langs])
    pairs = [("", a, b) for a, b in combinations(families, 2)]
    pairs += [(f, a, b) for f in families for a, b in combinations([x for x in languages if family(x) == f], 2)]
    columns, constants, slopes = [], [], []
    for level, a, b in pairs:
        names = own if level else groups
        rows = np.flatnonzero((names == a) | (names == b))
        y = np.where(names[rows] == a, 1.0, -1.0)
        w = linear_svm(x[rows], y)
        m = np.sort(np.abs(x[rows] @ w))
        columns.append(w[:-1] * scale), constants.append(w[-1]), slopes.append(3.0 / max(m[len(m) // 2], 1e-6))
    return Model(languages, families, pairs, np.stack(columns, 1).astype(np.float32) if pairs else np.zeros((1 << BITS, 0), np.float32), np.array(constants), np.array(slopes))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 3) -> Model | None:
    """A model of the rows that aren't held out. The driver gets at most per_language rows of trigram counts for each language, however often an id comes."""
    src = df.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    src = src.filter("id is not null and t is not null and l is not null").filter(~held_out("id"))
    sizes = {r.l: r["count"] for r in src.groupBy("l").count().collect()}  # one row a language
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (per_language + 4 * per_language**0.5) / n))))
    hashed = unit_hash(F.lit(seed), F.col("id"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("u", F.md5("t")))  # a task keeps per_language rows of a language at most
    chosen = src.withColumn("u", hashed).filter(F.col("u") <= share[F.col("l")]).withColumn("place", place).filter(F.col("place") <= per_language).select("id", "l", "u", "t")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sparse = []
            for t in batch.column(3):
                counts = trigram_counts(t.as_py())
                at = np.flatnonzero(counts)
                sparse.append(np.stack([at, counts[at]]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sparse, pa.binary())], names=["l", "u", "counts"])

    rows = sorted(chosen.mapInArrow(counted, "l string, u double, counts binary").collect(), key=lambda r: (r.l, r.u, bytes(r.counts)))
    if not rows:
        return None
    counts = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, r in enumerate(rows):
        at, n = np.frombuffer(r.counts, np.int32).reshape(2, -1)
        counts[i, at] = n
    return fit(counts, [r.l for r in rows])


def with_language(df: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the two columns more."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # families and trigrams: a size that the input doesn't set
    schema = T.StructType([*df.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    at = df.columns.index(text)
    names = [f.name for f in schema]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            langs, scores = shared.value.predict(texts) if shared.value and texts else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return numbered(df).mapInArrow(each, schema)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = train(df, key, text, lang, per_language)
    src = df.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("t"))
    found = with_language(src, model, "t")
    return found.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, languages: tuple[str, ...] | None = None, min_score: float = 0.4) -> DataFrame:
    """The rows of df, with all their columns, that are predicted to be in one of `languages` (None: any that was learned) with a score of `min_score` or more.

    Texts that the machines dispute, such as mixtures of languages or one word over and
    over, score below it. A table without labels has no machines that could reject a
    row, and comes back as it is.
    """
    model = train(df, key, text, lang, per_language)
    if model is None:
        return df
    pred, score = fresh(df, "_lang_pred"), fresh(df, "_lang_score")
    wanted = [x for x in model.languages if languages is None or x in languages]
    found = with_language(df, model, text, pred, score)
    return found.filter(F.col(pred).isin(wanted) & (F.col(score) >= min_score)).select(*(F.col(f"`{c}`") for c in df.columns))

"""Hard negatives against all scores of every anchor."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm.negatives import MultiIndex, hard_negatives, learn

ROW = "vec_id long, label int, embedding array<double>, id string, v int, s string"


def by_hand(rows, every=50, positives=5, negatives=3, window=(50, 95), scale=256):
    own = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = (label, [math.floor(c * scale) for c in x])
        own[i] = min(own.get(i, row), row)
    out = set()
    for a, (label, q) in own.items():
        if a % every:
            continue
        scored = sorted((-sum(m * n for m, n in zip(q, v, strict=True)), i, other == label) for i, (other, v) in own.items() if i != a and len(v) == len(q))
        for p, pid, same in [s for s in scored if s[2]][:positives]:
            fits = [(s, i) for s, i, same in scored if not same and window[0] * -p <= 100 * -s <= window[1] * -p]
            out |= {(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(fits[:negatives], 1)}
    return out


def found(df, **options):
    rows = hard_negatives(df, **options).collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("blocks", [{}, {"block": 400, "anchors": 60, "sample": 50}])
def test_equal_to_all_scores(spark, blocks):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(0, 4)), (middle[i % 6] + 0.6 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(int(i), 1, [0.5] * 8) for i in range(1000, 1040)] + [(int(i), 2, [0.4] * 8) for i in range(1040, 1080)]  # ties
    rows += [(2000, 1, [0.0] * 8), (2050, 1, [-1.0] * 8), (2100, 1, []), (2101, 1, []), (2102, 2, []), (2150, 3, [1.0, 2.0]), (2151, 3, [1.0, 1.0]), (2152, 2, [0.6, 0.7]), (2200, 9, [1.0] * 8)]
    rows += [(None, 1, [9.0] * 8), (50, None, [9.0] * 8), (2250, 1, None), (2251, 1, [None] * 8), (2300, 1, [math.nan] + [1.0] * 7), (2301, 2, [math.inf] + [1.0] * 7)]
    rows += rows[:60] + [(100, 0, [1.0] * 8), (101, 0, [0.1] * 8)]  # repeated rows, and ids with several
    df = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], ROW)
    assert found(df, **blocks) == by_hand(rows)


def test_options_labels_of_text_and_numbers_as_text(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], rng.normal(size=5).tolist()) for i in range(90)]
    df = spark.createDataFrame([(str(i), *r) for i, *r in rows] + [("x", "a", [1.0] * 5)], "vec_id string, label string, embedding array<double>")
    options = {"every": 9, "positives": 3, "negatives": 50, "window": (-400, 100), "scale": 1000}
    assert found(df, **options) == by_hand(rows, **options)
    assert found(df.limit(0)) == set()
    assert found(df, label=F.lit("all"), every=1) == set()


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, (rng.normal(size=4) * 2e6).round(3).tolist()) for i in range(60)]
    assert found(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), every=10) == by_hand(rows, every=10)


def test_bounds_hold_and_clusters_are_passed_over():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 32)) * 600
    x = np.floor(middle[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 32)) * 20).astype(np.int64)
    labels = rng.integers(0, 3, 8000)
    index = MultiIndex(np.arange(8000), labels, x, learn(list(x[:2000])))
    q = x[5]
    exact = x @ q
    sums = []
    for most, least, rows in index.cells(q):
        assert (exact[rows] <= most).all() and (exact[rows] >= least).all()
        sums.append(most)
    assert sums == sorted(sums, reverse=True)
    index.scored = 0
    ids, scores = index.positives(5, q, 5)
    assert scores.tolist() == sorted(np.delete(exact, 5), reverse=True)[:5]
    assert index.scored < 2500
    lo, hi = -(-50 * scores[0] // 100), 95 * scores[0] // 100
    index.scored = 0
    (got, values), = index.negatives(5, labels[5], q, [(lo, hi)], 3)
    fits = sorted((-exact[i], i) for i in range(8000) if labels[i] != labels[5] and lo <= exact[i] <= hi)[:3]
    assert [(-s, i) for s, i in zip(values.tolist(), got.tolist(), strict=True)] == fits
    assert index.scored < 8000

"""MinHash components against all pairs of full sets."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import minhash
from helixframe.llm.minhash import MINIMA, drop_near_sets, least_agreement, near_sets, signature


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {" ".join(words)} - {""}


def by_hand(docs, percent=85):
    """(doc_id, n, component, kept) of rows (doc_id, text), by all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        known = [d for d in groups[find(i)] if d is not None]
        least = min(known, default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return out


def found(df, **options):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_sets(df, **options).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def near_copies(rng, n, words, most):
    """A text and n others with up to `most` words changed."""
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, words, int(rng.integers(1, most + 1))):
            own[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("cell", [7, 1024])
def test_components_equal_all_pairs(spark, cell):
    rng = np.random.default_rng(11)
    texts = near_copies(rng, 120, 150, 14) + near_copies(rng, 3, 400, 9) + near_copies(rng, 5, 30, 1)
    texts += [None, "", " \n\t", "one two", "One TWO", "one two three four", "a b c d e", "a b c d e f", "A\x0bB C  D\nE f"]
    texts += [" ".join(f"s{i}" for i in range(60_000))] * 2
    texts += [" ".join(f"p{i}" for i in range(25)) + f" {tail}" for tail in ("", "and more of it here", "q r s t u v w x y z")]  # a shared passage
    docs = [(int(i) * 3 + 1, t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs += docs[:4] + [(docs[9][0], docs[9][1])]  # repeated rows
    df = spark.createDataFrame([(*d, "c", 1, 2, "h") for d in docs], "doc_id long, text string, node string, u int, V int, h string")
    got = found(df, cell=cell)
    assert ordered(got) == ordered(by_hand(docs))
    kept = {r.doc_id for r in drop_near_sets(df).collect()}
    assert kept == {d for d, _, _, k in by_hand(docs) if k} and drop_near_sets(df).columns == df.columns


def test_a_large_group_is_one_component(spark):
    rng = np.random.default_rng(3)
    docs = [(i, t) for i, t in enumerate(near_copies(rng, 3000, 200, 2))]  # each within 0.85 of the first
    got = found(spark.createDataFrame(docs, "doc_id long, text string"))
    assert len(got) == 3001 and {c for _, _, c, _ in got} == {0}


def test_ids_of_any_type_null_ids_and_empty_tables(spark):
    docs = [("b", "some words of a text here"), ("a", "some words of a text here"), (None, "some words of a text here"), (None, "alone"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    assert ordered(found(df)) == ordered([("b", 2, "a", False), ("a", 2, "a", True), (None, 2, "a", False), (None, 1, None, True), (None, 0, None, True)])
    assert drop_near_sets(df).count() == 4
    assert found(df.limit(0)) == [] and drop_near_sets(df.limit(0)).count() == 0


def test_signatures_estimate_the_similarity(spark):
    rng = np.random.default_rng(1)
    worst = 1.0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        b = np.concatenate([a[:170], np.unique(rng.integers(0, 1 << 63, 1, dtype=np.uint64))])  # 170 of 201
        x, y = (signature(s).view(np.uint8) for s in (a, b))
        worst = min(worst, float((x == y).mean()))
    assert worst * MINIMA >= least_agreement(85)  # here the similarity is even a little lower
    x, y = signature(a), signature(b)
    row = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<long>, b array<long>").select(minhash._equal_bytes(F.col("a"), F.col("b"))).first()
    assert row[0] == int((x.view(np.uint8) == y.view(np.uint8)).sum())

"""The audit of filters against every order applied in turn to every document."""

import re
from itertools import permutations

import numpy as np
import pytest

from helixframe.llm.filter_audit import audit, audit_documents, positional_counts, survival_words

DOCS = "doc_id long, text string, lang string, word string, part string, mask int"


@pytest.mark.parametrize("n", [0, 1, 2, 62, 63, 64, 1000, 20_000])
def test_positional_counts_equal_bits(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert positional_counts(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_a_word_holds_the_subsets_that_a_document_survives():
    words = survival_words(5)
    assert words[0] == (1 << 32) - 1 and words[31] == 1
    assert all(bool(words[m] >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


def by_hand(docs, labels):
    marks = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            good, bad = marks.get(doc_id, (False, False))
            marks[doc_id] = good or quality == 1, bad or toxic == 1
    parts = {}
    for doc_id, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in docs)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": copy,
        }
        parts.setdefault(lang or "", []).append((fails, *marks.get(doc_id, (False, False))))
    rows = {}
    for part, own in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = own
            for step, f in enumerate(o, 1):
                gone = [x for x in left if x[0][f]]
                failing = sum(x[0][f] for x in own)
                total[f] += len(gone)
                left = [x for x in left if not x[0][f]]
                rows[part, "".join(o), step] = [len(left), len(gone), failing - len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, o, step), r in rows.items():
            if p == part:
                r.append(total[o[step - 1]])
    return rows


def test_audit_equals_every_order_by_hand(spark):
    rng = np.random.default_rng(5)
    vocabulary = [*(f"w{i}" for i in range(400)), "Ä", "ß", "NASA", "A B", "x y"]
    texts = [None, "", " \t\n", "one\x0btwo\x0cthree", "50% off", "ALL CAPITALS"]
    for i in range(60):
        pool = vocabulary[: int(rng.choice([5, 60, 405]))]
        words = rng.choice(pool, int(rng.choice([0, 3, 199, 200, 201, 450])))
        texts.append(rng.choice([" ", "\n", "  "]).join(words) + rng.choice(["", " #", " AAAAAAAAAAAAAAAAAAAAAAAAA"]))
    texts += ["very long " * 30_000]
    picks = [texts[i] for i in rng.integers(0, len(texts), 150)]
    docs = [(int(rng.integers(0, 120)) if i % 40 else None, t, rng.choice(["en", "de", "fr"]) if i % 9 else None, "clash", "clash", 3) for i, t in enumerate(picks)]
    docs += docs[:3]
    labels = [(int(i), int(q), int(x)) for i, q, x in rng.integers(0, 2, (70, 3)) * [120, 1, 1] + rng.integers(0, 60, (70, 1)) * [1, 0, 0]] + [(None, 1, 1), (5, None, None)]
    got = audit_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(found) == len(got)
    assert found == by_hand(docs, labels)


def test_empty_tables_and_fewer_filters(spark):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_documents(spark.createDataFrame([], DOCS), no_labels).count() == 0
    assert audit_documents(spark.createDataFrame([(1, "a", "en", "", "", 0)], DOCS), no_labels).count() == 600
    words = spark.createDataFrame([("p", w, True, False) for w in (15, 5, 5, 1)], "part string, word long, good boolean, toxic boolean")  # of four: one fails none, two fail X, one both
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit(words, "XY").collect()}
    assert rows == {("YX", 1): (3, 1, 0, 0, 1), ("YX", 2): (1, 2, 1, 2, 5), ("XY", 1): (1, 3, 0, 2, 5), ("XY", 2): (1, 0, 1, 0, 1)}
    with pytest.raises(ValueError):
        audit(words, "ABCDEF")

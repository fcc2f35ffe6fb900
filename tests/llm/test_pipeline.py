import os

import pytest

from helixframe.llm import queries, simhash_similar

cp = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", 0), (None, "ein Text", None, None, None), (2, "some text", "en", "a", 9), (2, "some text", "en", "a", 9), (3, "Some Text", "en", "b", 9), (4, "x " * 5000, "de", "b", 9)]])
def test_stages_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for i, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, DIR)
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    packed = docs.collect()
    if rows:
        tokens = {(r.doc_id, r.piece): r.length for r in packed}
        assert tokens and {i for i, _ in tokens} <= {2, 4, None} and all(r.offset + r.length <= 2048 for r in packed)  # 1 has no letter, 3 is a near copy
    else:
        assert packed == []


def test_earlier_stages_are_deleted_and_results_stay(spark):
    import glob

    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/**/pipeline-*", recursive=True))
    out = cp.run(spark, DIR)
    new = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/**/pipeline-*", recursive=True)) - before
    assert len(new) == 1 and [os.path.basename(p) for p in glob.glob(f"{new.pop()}/*")] == ["mixing"]
    assert out.count() == out.count() > 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_run_against_brute_force(spark):
    import hashlib

    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    lang = {r.doc_id: (r.lang_pred, r.score) for r in queries.op4_language_id(spark, DIR).collect()}
    left = {i: r for i, r in docs.items() if lang[i][0] in cp.LANGUAGES and lang[i][1] >= 0.4}
    last = {}
    for i in sorted(left):
        last[left[i].text or ""] = i
    left = {i: left[i] for i in last.values()}
    from test_llm_similar import brute

    comp, links = brute([(i, r.text) for i, r in left.items()])
    rows = spark.createDataFrame([tuple(r) for r in left.values()], DOCS)
    found = {r.node: r.root for r in simhash_similar.similar_components(rows).collect()}  # its recall is tested beside it
    assert links and found and all(comp[i] == comp[root] for i, root in found.items())
    left = {i: r for i, r in left.items() if found.get(i, i) == i}
    n = {}
    for r in left.values():
        n[r.source] = n.get(r.source, 0) + 1
    total, root = sum(n.values()), sum(v**0.5 for v in n.values())
    copies = {}
    import math

    for i, r in left.items():
        rate = total * n[r.source] ** 0.5 / root / n[r.source]
        u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k, p = 0, math.exp(-rate)
        c = p
        while c < u:
            k += 1
            p *= rate / k
            c += p
        copies[i] = k
    rows = cp.run(spark, DIR).collect()
    got = {}
    for r in rows:
        if r.piece == 0:
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: k for i, k in copies.items() if k}
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= 2048

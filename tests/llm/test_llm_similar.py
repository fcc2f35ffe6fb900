import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import near
from helixframe.llm import simhash_similar as ss

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def corpus(seed, groups, copies, words=150):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randint(words // 3, 2 * words))]
        rows.append(base)
        for _ in range(rng.randint(0, copies)):
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(99))
            rows.append(w)
    rng.shuffle(rows)
    return [(5000 - i, " ".join(w)) for i, w in enumerate(rows)]


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if similarity(a, b) >= 0.8:
                links.append((i, j, similarity(a, b)))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}, links


@pytest.mark.parametrize("cell", [1024, 3])
def test_groups_against_brute_force(spark, cell):
    rows = corpus(1, 90, 6)
    want, links = brute(rows)
    got = {r.node: r.root for r in ss.similar_components(docs(spark, rows), cell=cell).collect()}
    assert all(want[i] == want[root] for i, root in got.items())  # no link that brute force lacks
    found = sum(got.get(i, i) == got.get(j, j) for i, j, _ in links)
    assert len(links) > 200 and found / len(links) >= 0.98
    sure = [(i, j) for i, j, s in links if s >= 0.9]
    assert len(sure) > 30 and all(got.get(i, i) == got.get(j, j) for i, j in sure)


def test_fingerprints_against_brute_force():
    rng = random.Random(2)
    for n in (1, 4, 5, 6, 300, 2000):
        text = " ".join("w" + str(rng.randrange(300)) for _ in range(n))
        h = sorted({xxhash.xxh64_intdigest(" ".join(s), 42) for s in shingles(text)})
        assert near.shingle_hashes(text, 5).tolist() == h
        p, keys = ss.print_and_keys(near.shingle_hashes(text, 5))
        lead = [sum(1 if x >> j & 1 else -1 for x in h) for j in range(64)]
        assert int(p[0]) & (1 << 64) - 1 == sum(1 << j for j in range(64) if lead[j] > 0)
        around = keys.reshape(ss.SEGMENTS, ss.PROBES)
        assert (around >> 32 == np.arange(ss.SEGMENTS)[:, None]).all()
        values = around[0] >> 16 & 0xFFFF
        assert values[0] == int(p[0]) & 0xFFFF and set((values ^ values[0]).tolist()) == {0, *(1 << j for j in sorted(range(16), key=lambda j: abs(lead[j]))[:4])}
        assert [int(t) for t in around[:, 0] & 0xFFFF] == [min(x * int(f) & (1 << 64) - 1 for x in h) >> 32 & 0xFFFF for f in ss.FACTORS]


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(3)
    base = ["w" + str(rng.randrange(5000)) for _ in range(400)]
    rows = [(i, " ".join(w)) for i in range(600) for w in [[*base[:10], f"x{i}", *base[10:]]]]
    other = corpus(4, 20, 0)
    got = {r.node: r.root for r in ss.similar_components(docs(spark, rows + other)).collect()}
    assert got == dict.fromkeys(range(600), 0)


def test_a_large_group_is_a_star_and_what_is_apart(spark):
    rows = spark.range(3000).select((F.col("id") % 4).alias("key"), F.col("id").alias("node")).unionByName(spark.range(0, 3000, 2).select(F.lit(9).cast("long").alias("key"), F.col("id").alias("node")))
    met = near.company(rows.unionByName(spark.createDataFrame([(77, 1)], "key long, node long")), ["key"])
    pairs = {(r.u, r.v) for r in near.star_pairs(met, ["key"]).collect()}
    assert len(pairs) <= 5 * 3000 and {x for pair in pairs for x in pair} == set(range(3000)) and met.filter("key = 77").count() == 0
    # 10 nodes of key 9 are not in the component of the others
    found = spark.range(3000).filter("id >= 20").select(F.col("id").alias("node"), F.lit(20).cast("long").alias("root"))
    carried = spark.range(3000).select(F.col("id").alias("node"))
    every = lambda run: near.paired(run, list(near.others_of(run)))
    for cell in (1024, 7):
        told = [(r.u, r.v) for r in near.apart_pairs(met.filter("key = 9"), ["key"], found, carried, every, cell).collect()]
        assert len(told) == len(set(told)) and set(told) == {(u, v) for u in range(0, 20, 2) for v in range(u + 2, 3000, 2)}


def test_a_group_that_stays_apart_has_a_row_for_each_node_and_unit(spark):
    # 500 nodes that share 80 buckets and are linked with nothing; one of them meets another, which is linked already elsewhere
    rows = spark.range(500).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(79).cast("long"))).alias("key"), F.col("id").alias("node"))
    met = near.company(rows.unionByName(spark.createDataFrame([(99, 3), (99, 700), (98, 700), (98, 701)], "key long, node long")), ["key"])
    found = spark.createDataFrame([(700, 700), (701, 700)], "node long, root long")
    units = near.units_of(met, ["key"], found)
    assert units.count() == 501 and {r.node for r in units.collect()} == {*range(500), 700}  # 3 has the most company, so it is the pivot of all
    carried = spark.range(702).select(F.col("id").alias("node"))
    every = lambda run: near.paired(run, list(near.others_of(run)))
    for cell in (1024, 90):
        told = [(r.u, r.v) for r in near.apart_pairs(met, ["key"], found, carried, every, cell).collect()]
        assert len(told) == len(set(told)) and {(u, v) for u in range(500) for v in range(u + 1, 500)} | {(3, 700)} <= set(told)


def test_links_of_a_group_whose_ends_differ_are_all_found(spark):
    rng = random.Random(8)
    base = ["w" + str(rng.randrange(5000)) for _ in range(260)]
    rows = []
    for i in range(400):  # from near copies of the first to texts that are like few others
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want, links = brute(rows)
    got = {r.node: r.root for r in ss.similar_components(docs(spark, rows)).collect()}
    assert len(set(want.values())) > 5 and all(want[i] == want[root] for i, root in got.items())
    lost = [(i, j) for i, j, _ in links if got.get(i, i) != got.get(j, j)]
    assert len(lost) <= len(links) // 500


def test_ids_of_text(spark):
    df = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "others"), ("c", "one two three four five six")], "doc_id string, text string")
    assert sorted(r.doc_id for r in ss.drop_similar(df).collect()) == ["a", "c", "c"]


def test_odd_rows(spark):
    long = "word%d " * 3
    rows = [(1, None), (2, ""), (3, " \t "), (4, "a b"), (5, "A  b"), (5, "A b"), (None, "a b"), (None, "a b"), (6, "a b c"), (7, " ".join(f"w{i % 70000}" for i in range(700_000))), (8, " ".join(f"w{i % 70000}" for i in range(699_990))), (9, long)]
    df = docs(spark, rows).select("*", F.lit(1).alias("_NEAR_ID"), F.lit(2).alias("node"), F.lit(3).alias("a.b"))
    left = ss.drop_similar(df)
    assert left.columns == df.columns
    by = defaultdict(int)
    for r in left.collect():
        by[r.doc_id] += 1
    assert by == {1: 1, 2: 1, 3: 1, 4: 1, None: 2, 6: 1, 7: 1, 9: 1}
    assert ss.drop_similar(df.filter("false")).count() == 0

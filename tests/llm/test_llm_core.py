import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import components as cc
from helixframe.llm import exact_dedup as xd
from helixframe.llm import mixing, packing, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp int"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], schema)


ODD = [(1, None), (2, ""), (3, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "no id"), (6, "ß word " * 3000), (7, " \t\n "), (8, "A B c D")]


# --- sharding
def test_shards_are_gapless_and_growth_moves_rows_only_into_the_new_shard(spark):
    rows = sharding.shard_documents(docs(spark, [(i, f"text {i}") for i in range(3000)]), shards=24).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len(f"text {r.doc_id}") + 8 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode())
        assert r.grown_shard in (r.shard, 24)
    assert sorted(by) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert 60 < sum(r.grown_shard == 24 for r in rows) < 190


def test_weights_set_the_shares(spark):
    df = spark.range(20_000).select(sharding.shard_of("id", [1.0, 3.0]).alias("s"))
    share = df.filter("s = 1").count() / 20_000
    assert abs(share - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.shard_of("id", [1.0, 0.0])


def test_sharding_of_odd_rows(spark):
    rows = sharding.shard_documents(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].size == 8 and by[1].text_crc32 == 0 and by[None].shard is not None
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    sharding.write_shards(docs(spark, ODD).drop("shard"), str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)
    with pytest.raises(ValueError):
        sharding.write_shards(docs(spark, ODD), str(tmp_path / "no"), shards=4)


def test_shards_against_brute_force(spark):
    keys = [*range(-50, 400), None, 2**62]
    weights = [1.0, 2.5, 0.5, 1.0, 3.0]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = df.select("k", sharding.shard_of("k", weights).alias("s"), *(F.xxhash64(F.lit(i), "k").alias(f"h{i}") for i in range(len(weights)))).collect()
    for r in rows:
        scores = [-w / math.log((((r[f"h{i}"] & (1 << 64) - 1) >> 12) + 0.5) / (1 << 52)) for i, w in enumerate(weights)]
        best = max(scores)
        assert abs(scores[r.s] - best) <= 1e-12 * best and all(i >= r.s or x < best for i, x in enumerate(scores))
    long = xxhash.xxh64_intdigest((7).to_bytes(8, "little"), xxhash.xxh64_intdigest((3).to_bytes(4, "little"), 42))
    assert df.filter("k = 7").select(F.xxhash64(F.lit(3), "k").alias("h")).first().h & (1 << 64) - 1 == long


def test_slots_of_one_key_and_clashing_names(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("shard"), F.col("id").alias("_PART"), F.lit("x").alias("_Start"), F.lit("y").alias("a.b"))
    out = sharding.with_slots(df, "shard", "doc_id")
    assert out.columns == [*df.columns, "slot"] and sorted(r.slot for r in out.select("slot").collect()) == list(range(5000))


def test_placing_pieces_beside_clashing_names(spark):
    rows = [(i, 0, 1 + i % 90, "x", "y", i) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, _LEN string, `a.b` string, _rank long")
    out = packing.pack_pieces(df, 100)
    assert out.columns == [*df.columns, "sequence_id", "offset"]
    by = defaultdict(list)
    for r in out.collect():
        assert (r[3], r[4], r[5]) == ("x", "y", r.doc_id)
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 100


def test_very_long_texts_and_clashing_names_in_any_case(spark):
    text = "long word " * 500_000
    df = spark.createDataFrame([(1, text, "a"), (2, text, "a"), (3, "x", "b")], "doc_id long, text string, source string")
    more = df.select("*", *(F.lit(i).alias(x) for i, x in enumerate(["_DUP_h", "KEEP_id", "H", "sha", "a.b", "_Mix_Source", "COUNT", "Fp"])))
    left = xd.drop_copies(more)
    assert left.columns == more.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == [2, 3]
    assert sorted(map(tuple, xd.exact_dedup(more).collect())) == sorted(map(tuple, xd.exact_dedup(df).collect()))
    mixed = mixing.mix_sources(more, epochs=3.0)
    assert mixed.columns == more.columns and mixed.count() > 0
    with pytest.raises(ValueError, match="COUNT|count"):
        mixing.mix_sources(more, copy="count")
    assert sharding.shard_documents(more).filter("doc_id = 1").first().size == len(text) + 8
    near = {r.doc_id: r for r in simhash.near_duplicates(more).collect()}
    assert near[1].component_id == near[2].component_id == 1 and simhash.drop_near_copies(more).columns == more.columns
    assert sum(r.length for r in packing.pack_documents(more).collect() if r.doc_id == 1) > 1_000_000


# --- exact dedup
def test_exact_dedup_against_brute_force_and_collisions(spark):
    data = [(i, random.Random(i).choice(["x", "y", "zz", "", None, "ww"])) for i in range(200)]
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    for digest in (xd.md5_128, lambda t: F.length(t).cast("string").cast("binary")):  # the second one collides
        for r in xd.exact_dedup(docs(spark, data), digest=digest).collect():
            own = groups[dict(data)[r.doc_id] or ""]
            assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))


def test_exact_dedup_of_odd_rows(spark):
    rows = xd.exact_dedup(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert [r.kept for r in rows if r.doc_id == 4] == [True, True]
    left = xd.drop_copies(docs(spark, ODD))
    assert left.columns == docs(spark, ODD).columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 2, 4, 6, 7, 8]
    assert xd.exact_dedup(docs(spark, [])).count() == 0 and xd.drop_copies(docs(spark, [])).count() == 0


# --- mixing
def test_counts_are_the_poisson_quantiles(spark):
    data = [(i, "t", None, "abc"[i % 7 % 3] if i % 11 else None) for i in range(3000)]
    weights = {"a": 2.0, "b": 1.0, "c": 1.0}
    n = Counter(s for _, _, _, s in data)
    out = mixing.mix_sources(docs(spark, data), weights=weights, copy="k", rate="rate", shuffle_key="o").collect()
    got, rates = Counter(r.doc_id for r in out), {r.source: r.rate for r in out}
    assert set(rates) == {"a", "b", "c"}
    import hashlib

    for i, _, _, s in data:
        rate = 3000 * weights.get(s, 0) / 4 / n[s]
        u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k, p = 0, math.exp(-rate)
        c = p
        while c < u:
            k += 1
            p *= rate / k
            c += p
        assert got[i] == (k if rate else 0)
        if s in rates:
            assert math.isclose(rates[s], rate)
    assert abs(len(out) - 3000) < 200


def test_mixing_of_odd_rows(spark):
    out = mixing.mix_sources(docs(spark, ODD), epochs=5.0)
    assert out.columns == docs(spark, ODD).columns and out.count() > 0
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    with pytest.raises(Exception, match="repeated over"):
        mixing.mix_sources(docs(spark, [(1, "a", None, "s")] * 3), epochs=1e4).count()


def test_a_small_source_of_a_large_table_has_any_rate(spark):
    data = [(i, "t", None, "small" if i < 8 else "large") for i in range(4000)]
    out = mixing.mix_sources(docs(spark, data), weights={"small": 1.0, "large": 1.0}, copy="k", rate="rate", shuffle_key="o").collect()
    got = Counter(r.doc_id for r in out if r.source == "small")
    assert {r.rate for r in out if r.source == "small"} == {250.0} and len(set(got.values())) > 1
    assert all(abs(n - 250) < 6 * 250**0.5 for n in got.values()) and abs(sum(got.values()) - 2000) < 5 * 2000**0.5
    assert all(sorted(r.k for r in out if r.doc_id == i) == list(range(n)) for i, n in got.items()) and len({r.o for r in out}) == len(out)
    far = mixing.mix_sources(docs(spark, [(i, "t", None, "s" if i else "x") for i in range(2000)]), weights={"x": 1.0}).count()
    assert abs(far - 2000) < 5 * 2000**0.5


def test_whole_documents_are_mixed(spark, tmp_path):
    from helixframe.llm import queries

    rows = [(i, f"text {i} " * (i % 40), "en", "ab"[i % 7 > 0], i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op5_poisson_mixing_documents"](spark, str(tmp_path)).collect()
    ids = queries.QUERIES["op5_poisson_mixing"](spark, str(tmp_path)).collect()
    assert {tuple(r)[:5] for r in out} <= set(rows)
    assert sorted((r.doc_id, r.copy, r.shuffle_key) for r in out) == sorted((r.doc_id, r.copy, r.shuffle_key) for r in ids)


# --- packing
def test_plan_places_every_piece_once_and_fills_sequences():
    for seed in range(20):
        rnd = random.Random(seed)
        cap = rnd.choice([7, 64, 2048])
        lengths = [rnd.randint(1, cap) if rnd.random() < 0.7 else rnd.randint(1, max(1, cap // 4)) for _ in range(rnd.randint(1, 4000))]
        counts = Counter(lengths)
        rows, used, spans = packing.plan(dict(counts), cap), Counter(), defaultdict(list)
        for i, (s, rank, first, each, offset) in enumerate(rows):
            end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == s else counts[s]
            for k in range(end - rank):
                q, o = first + k // each, offset + k % each * s
                spans[q].append((o, s))
                used[s] += 1
        assert used == counts
        for parts in spans.values():
            at = 0
            for o, s in sorted(parts):
                assert o == at
                at += s
            assert at <= cap
            assert sum(3 * s > cap for _, s in parts) <= 2
        lower = max(-(-sum(lengths) // cap), sum(2 * s > cap for s in lengths))
        assert len(spans) <= lower * 1.12 + 2


def test_packing_ids_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*(t for _, t in ODD), "Hi  there,\n\n you're\tok. 12 34a <|endoftext|> x", "Straße überall x", "x" * 30_000, "mot été, l'eau.\nNew line", "\nlead", "a \n b", "trail ", "漢字 と かな", "\x1c a\x85b"]
    data = list(enumerate(texts))
    rows = packing.pack_documents(docs(spark, data), capacity=2048).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in data:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        got = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and sum(r.length for r in got) == len(ids)
        assert len(got) == -(-len(ids) // 2048) and all(r.length == 2048 for r in got[1:])
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    whole = packing.sequences(docs(spark, data), capacity=2048).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)
    assert packing.pack_documents(docs(spark, [])).count() == 0


# --- simhash and components
def brute_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, prints):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [min(least[find(i)]) for i in range(len(ids))]


@pytest.mark.parametrize("dense", [1000, 3])
def test_simhash_against_brute_force(spark, dense):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(50)) for _ in range(rnd.choice([1, 2, 3, 40, 200, 600]))) for _ in range(40)]
    texts = [*base, None, "", " \n", "A B"]
    for t in base:
        words = t.split()
        for _ in range(4):
            w = list(words)
            w[rnd.randrange(len(w))] = "new"
            texts.append(" ".join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    data = [(1000 - i, t) for i, t in enumerate(texts)]
    prints = [brute_print(t) for _, t in data]
    want = brute_components([i for i, _ in data], prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, data), dense=dense).collect()}
    assert [got[i].fingerprint for i, _ in data] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, _ in data] == want
    assert len(set(want)) < len(want) - 20


@pytest.mark.parametrize("dense", [1000, 2])
def test_links_between_crowded_halves(spark, dense):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    prints = {0, 7, 15, centre}
    while len(prints) < 260:
        x = rnd.choice(sorted(prints))
        for _ in range(rnd.randint(1, 6)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    want = brute_components(prints, prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    root = {r.node: r.root for r in cc.components(simhash.near_edges(df, dense=dense)).collect()}
    same = defaultdict(set)
    for s, w in zip(signed, want, strict=True):
        same[w].add(root.get(s, s))
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


def test_near_copies_of_odd_rows(spark):
    left = simhash.drop_near_copies(docs(spark, ODD))
    assert left.columns == docs(spark, ODD).columns
    ids = [r.doc_id for r in left.collect()]
    assert 1 in ids and 2 not in ids and 7 not in ids and 3 in ids and 8 not in ids and None in ids
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.drop_near_copies(docs(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "u long, v long")
    assert {r.node: r.root for r in cc.components(edges).collect()} == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}

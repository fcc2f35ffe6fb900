import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import html_extract as hx
from helixframe.llm import language_id as lid
from helixframe.llm import nearest as nn
from helixframe.llm import substring_dedup as sd
from helixframe.llm import toxicity as tox
from helixframe.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "1234 ... !!"), (4, "le chat est là"), (4, "le chat est là"), (None, "no id here"), (6, "ß word " * 4000), (7, " \t\n ")]
WORDS = {"en": "the of and that with was this have from they", "de": "der die und das mit von nicht ist auf für", "fr": "le la les des que dans est pour qui sur", "es": "el los que las con por para una del está"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


# --- language
def test_language_is_learned_and_odd_rows_are_und(spark):
    rng = random.Random(2)
    rows = [(100 + i, prose(rng, lang := rng.choice(list(WORDS)), rng.randint(5, 60)), lang) for i in range(400)]
    out = {r.doc_id: r for r in lid.identify(docs(spark, [*rows, *ODD])).collect()}
    held = [(out[i].lang_pred, lang) for i, _, lang in rows if out[i].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3, 7))
    assert out[4].lang_pred == "fr" and 0 <= out[4].score <= 1 and out[None].lang_pred != "und"
    import zlib

    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)


def test_language_does_not_see_labels_of_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang := "en" if i % 2 else "fr", 20), lang) for i in range(200)]
    df = docs(spark, rows)
    spoiled = df.withColumn("lang", F.when(held_out("doc_id"), "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, lid.identify(d).collect())) for d in (df, spoiled))
    assert a == b


def test_scores_depend_on_neither_neighbours_nor_length(spark):
    rng = random.Random(4)
    model = lid.fit(np.stack([lid.trigram_counts(prose(rng, lang, 30)) for lang in WORDS for _ in range(10)]).astype(np.float32), [lang for lang in WORDS for _ in range(10)])
    texts = [prose(rng, "de", 50), "x", prose(rng, "es", 300_000), "é", prose(rng, "fr", 3)]
    together = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.array_equal(together[1], np.concatenate([a[1] for a in alone]))
    assert together[0][0] == "de" and together[0][2] == "es"


def test_language_without_labels_or_rows(spark):
    assert {r.lang_pred for r in lid.identify(docs(spark, [(1, "text"), (2, "more")])).collect()} == {"und"}
    assert lid.identify(docs(spark, [])).count() == 0
    one = lid.identify(docs(spark, [(i, "some text", "en") for i in range(20)])).collect()
    assert {r.lang_pred for r in one} == {"en"}


def test_rows_go_by_their_predicted_language(spark):
    rng = random.Random(6)
    rows = [(100 + i, prose(rng, lang := rng.choice(list(WORDS)), 25), lang) for i in range(300)]
    df = docs(spark, [*rows, *ODD, (900, "12 + 30"), (901, prose(rng, "de", 9) + " " + prose(rng, "es", 9))])
    pred = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(df).collect()}
    for languages, least in ((None, 0.4), (("de", "fr"), 0.4), (("de",), 0.9), (("xx",), 0.0)):
        left = lid.keep_identified(df, languages=languages, min_score=least)
        want = {i for i, (a, s) in pred.items() if a != "und" and (languages is None or a in languages) and s >= least}
        assert left.columns == df.columns and {r.doc_id for r in left.collect()} == want
    assert len(want) == 0


def test_a_table_without_labels_comes_back_whole(spark):
    df = docs(spark, [*ODD, (50, "text")]).withColumn("lang", F.lit(None).cast("string"))
    assert lid.keep_identified(df).count() == len(ODD) + 1


def test_votes_against_brute_force():
    rng = np.random.default_rng(3)
    langs = ["en", "de", "nl", "fr", "es", "it", "ru", "xx"]
    fams = sorted({lid.family(x) for x in langs})
    pairs = [("", a, b) for i, a in enumerate(fams) for b in fams[i + 1 :]]
    for f in fams:
        own = sorted(x for x in langs if lid.family(x) == f)
        pairs += [(f, a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    m = lid.Model(sorted(langs), fams, pairs, rng.normal(size=(1 << lid.BITS, len(pairs))).astype(np.float32), rng.normal(size=len(pairs)), np.abs(rng.normal(size=len(pairs))) * 3)
    texts = ["".join(rng.choice(list("abcdé ß,"), n)) + "a" for n in (0, 1, 5, 80, 3000)]
    got, scores = m.predict(texts)
    for t, g, s in zip(texts, got, scores, strict=True):
        raw = b" " + t.lower().encode() + b" "
        places = [((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> 32 - lid.BITS for i in range(len(raw) - 2)]
        sure = 1 / (1 + np.exp(-(m.weights[places].astype(float).mean(0) + m.constants) * m.slopes))

        def winner(level, names):
            belief = {n: sum(sure[k] if n == a else 1 - sure[k] for k, (at, a, b) in enumerate(pairs) if at == level and n in (a, b)) for n in names}
            votes = {n: sum((sure[k] >= 0.5) == (n == a) for k, (at, a, b) in enumerate(pairs) if at == level and n in (a, b)) for n in names}
            best = max(sorted(names), key=lambda n: (votes[n], round(belief[n], 5)))
            return best, belief[best] / (len(names) - 1) if len(names) > 1 else 1.0

        f, outer = winner("", fams)
        lang, inner = winner(f, [x for x in langs if lid.family(x) == f])
        assert g == lang and np.isclose(s, outer * inner, rtol=1e-4)


def test_language_of_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang := list(WORDS)[i % 4], 30), lang) for i in range(120)]
    df = docs(spark, [*rows, (200, prose(rng, "es", 1_200_000)), (201, None)])
    more = df.select("*", F.lit(1).alias("_LANG_pred"), F.lit(2).alias("ID"), F.lit("q").alias("a.b"), F.lit(3).alias("Held_out"))
    assert sorted(map(tuple, lid.identify(more).collect())) == sorted(map(tuple, lid.identify(df).collect()))
    left = lid.keep_identified(more)
    assert left.columns == more.columns and {200} < {r.doc_id for r in left.select("doc_id").collect()}


# --- toxicity
def labelled(spark, n=600):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(n):
        words = prose(rng, "en", rng.randint(3, 200)).split()
        kind = rng.random()
        if kind < 0.2:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(kind < 0.2)))
    return docs(spark, rows), spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int"), {i: t for i, _, t in marks}


def test_toxicity_on_held_out_rows(spark):
    df, labels, truth = labelled(spark)
    rows = tox.score_toxicity(df.unionByName(docs(spark, [(None, None), (9000, ""), (9001, "what a MORON")])), labels).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows) and len(rows) == 603
    by = {r.doc_id: r for r in rows}
    assert by[9001].predicted == 1 and by[9000].predicted == 0 and by[None].predicted == 0


def test_pairs_mean_what_single_terms_do_not():
    a, b = (int(h[0]) for _, h in (next(tox.term_hashes([w])) for w in ("foo", "bar")))
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(2000):
        x = rng.random(2) < 0.5
        rows.append(np.array([t for t, on in zip((a, b), x, strict=True) if on] + [int(rng.integers(0, 50))]))
        y.append(int(x[0] != x[1]))  # exclusive or: no weighted sum tells it
    m = tox.fit(rows, np.array(y), epochs=30)
    got = m.score(["foo bar", "foo", "bar", "none"])
    assert (m.number[[a, b]] >= 0).all()
    assert got[0] < 0.5 < got[1] and got[3] < 0.5 < got[2]


def test_scores_are_sums_over_all_pairs():
    rng = np.random.default_rng(2)
    number = np.full(1 << tox.BITS, -1, np.int32)
    words = [f"w{i}" for i in range(40)]
    hashed = [int(next(tox.term_hashes([w]))[1][0]) for w in words]
    number[hashed] = np.arange(40)
    m = tox.Machine(number, 0.3, rng.normal(size=40), rng.normal(size=(40, 3)))
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 7, 60)] + ["w1 " * 2_000_000 + "w2"]
    want = []
    for t in texts:
        own = sorted({words.index(x) for x in t.split()})
        pairs = sum(float(m.vectors[a] @ m.vectors[b]) for i, a in enumerate(own) for b in own[:i])
        want.append(1 / (1 + np.exp(-(0.3 + m.weights[own].sum() + pairs))))
    assert np.allclose(m.score(texts), want) and np.allclose(m.chance([np.array([hashed[i] for i in sorted({words.index(x) for x in t.split()})], int) for t in texts]), want)


def test_toxicity_of_a_table_with_other_columns(spark):
    df, labels, truth = labelled(spark)
    more = df.select(*df.columns, F.lit(0.9).alias("y"), F.lit(1).alias("U"), F.lit("x").alias("k.k"), F.lit(True).alias("Held_Out"))
    assert sorted(tox.score_toxicity(more, labels.withColumn("Text", F.lit("?"))).collect()) == sorted(tox.score_toxicity(df, labels).collect())


def test_toxicity_without_labels_or_rows(spark):
    df, labels, _ = labelled(spark, 20)
    assert {r.score for r in tox.score_toxicity(df, labels.filter("toxic = 7")).collect()} == {0.0}
    assert tox.score_toxicity(docs(spark, []), labels).count() == 0


def test_hashed_words_do_not_depend_on_their_place():
    texts = ["alpha beta", "xx alpha", "Alpha.beta;alphabet"]
    by = [set(), set(), set()]
    for doc, h in tox.term_hashes(texts):
        for d, x in zip(doc, h, strict=True):
            by[d].add(int(x))
    alone = {int(x) for _, h in tox.term_hashes(["alpha"]) for x in h}
    assert alone <= by[0] & by[1] & by[2]


# --- html
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><p>Site name, and a long tagline, of the site.</p></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-banner"><p>We use cookies, please accept, thank you.</p></div><!-- <p>no</p> -->
<article><h1>A   title</h1><p>First &amp; foremost, this is <b>bo</b>ld text;<br>it goes on,\nand on.<p>Second paragraph, unclosed, caf&eacute; &#33; &lt;tag&gt;<ul><li>An item, that matters.</ul>
<div class="ad">Buy now, cheap, very cheap!</div><section id="comments"><p>I disagree, as a reader, with all this.</p></section></article><aside><p>Related things, long text, many words.</p></aside>
<form><p>Subscribe, please, now.</p></form><footer>&copy; us</footer>"""
WANT = "A title First & foremost, this is bold text; it goes on, and on. Second paragraph, unclosed, café ! <tag> An item, that matters."


def test_main_text_of_a_page():
    assert hx.main_text(PAGE) == WANT


@pytest.mark.parametrize(("html", "want"), [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<script>x", ""), ("<p>a<p>b", "a b"), ("<p>x</p><style>y</style>z", "x z"), ("<p title='a>b'>q", "q"), ("<p>1 < 2 & 3 > 2", "1 < 2 & 3 > 2"), ("<div><p>cut &am", "cut &am")])
def test_odd_pages(html, want):
    assert hx.main_text(html) == want


def test_pages_without_semantic_tags_go_by_paths():
    menu = "".join(f"<li><a href={i}>Entry {i}</a></li>" for i in range(12))
    body = "".join(f"<p>Paragraph {i} has a good deal of text, with commas, and with full stops. It goes on for long.</p>" for i in range(8))
    html = f"<body><ul>{menu}</ul><div><div>{body}</div></div><table><tr><td>x<td>y</table></body>"
    text = hx.main_text(html)
    assert "Entry" not in text and all(f"Paragraph {i} " in text for i in range(8))


def test_extraction_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "<p>" + "word, " * 30_000, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = hx.extract_pages(df).collect()
    assert sorted(r.n_chars for r in rows)[0] == 0 and [r.text for r in rows if r.page_id == 1] == [WANT, WANT]
    assert all(r.n_chars == len(r.text) for r in rows) and hx.extract_pages(df.filter("false")).count() == 0


def article(html):
    import re
    from html import unescape

    inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    return " ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)", m[0]) else "", inner)).split())


@needs_tables
def test_articles_of_the_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    for r in hx.extract_pages(spark.read.parquet(f"{DIR}/pages.parquet")).collect():
        assert r.text == article(pages[r.page_id])


@needs_tables
def test_ratios_find_the_text_without_tags_and_classes_to_go_by(spark, monkeypatch):
    import re

    pages = [r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    unmarked = [re.sub(r' class="[^"]*"|</?article>', "", h) for h in pages]
    plain = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", re.sub(r' class="[^"]*"', "", h)) for h in pages]
    right = lambda htmls: sum(hx.main_text(h) == article(w) for h, w in zip(htmls, pages, strict=True)) / len(pages)
    assert right(unmarked) >= 0.95 and right(plain) >= 0.85
    before = [hx.main_text(h) for h in unmarked], [hx.main_text(h) for h in plain]
    monkeypatch.setattr(hx, "path_ratios", lambda found: dict.fromkeys((b.path for b in found), 1.0))  # the same ratio everywhere
    for htmls, texts in zip((unmarked, plain), before, strict=True):
        assert sum(hx.main_text(h) != t for h, t in zip(htmls, texts, strict=True)) / len(texts) > 0.9


def test_ratios_against_brute_force():
    from html.parser import HTMLParser

    class Paths(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.texts = [], {}

        def handle_starttag(self, tag, attrs):
            self.open.append(tag)

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            if data.strip():
                blocky = tuple(t for t in self.open if t not in hx.INLINE)
                self.texts.setdefault(blocky, []).append((" ".join(data.split()), "a" in self.open))

    html = "<html><body><div><ul><li><a>One</a></li><li><a>Two!</a></li></ul></div><div><p>Some text, long; and more. Yes.</p><p>Short</p><section><p>Other: text</p></section></div><p>x, y</p></body></html>"
    want = Paths()
    want.feed(html)
    expected = []
    for texts in want.texts.values():
        letters, n = sum(len(t) for t, _ in texts), len(texts)
        marks = (sum(c in ".,;:!?" for t, _ in texts for c in t) + 0.5) / n
        plain = sum(len(t) for t, linked in texts if not linked) / letters
        expected.append(letters / n / (letters / n + hx.LETTERS) * marks / (marks + hx.MARKS) * plain)
    assert np.allclose(sorted(hx.path_ratios(hx.parse(html).blocks).values()), sorted(expected))


@pytest.mark.parametrize("unit", ["<div>", "<div>x", "<p><b>y", "</div>", "<li><ul>z", "<li>z", "<td><table>q", "<!--", "<a href='", "&amp;", "<dd><div>"])
def test_hostile_pages_take_work_in_proportion(unit):
    import time

    def took(n):
        began = time.perf_counter()
        hx.main_text("<ul>" + unit * n + "end")
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 40 * max(took(10_000), 0.01) and took(100_000) < 20


def test_a_very_long_page_is_read_whole():
    html = "<nav><a href=1>Menu</a></nav><article>" + "<p>A sentence, with a comma, of some length. And so on.</p>" * 100_000 + "</article>"
    assert hx.main_text(html).count("A sentence") == 100_000 and "Menu" not in hx.main_text(html)


# --- nearest
def brute(ids, x, k, every):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            other = ids != i
            s = x[other] @ v
            out[int(i)] = [int(j) for j in ids[other][np.lexsort((ids[other], -s))][:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")


def test_recall_of_the_search(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[::3] *= 1.7
    ids = np.arange(1500)
    rows = nn.nearest(frame(spark, [(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]), k=10, every=20, block=400, queries=30).collect()
    want = brute(ids, x.astype(float), 10, 20)
    hits = sum(r.vec_id in want[r.query_id] for r in rows)
    assert len(rows) == 750 and hits / 750 >= 0.9
    for q in want:
        own = sorted((r["rank"], r.score, r.vec_id) for r in rows if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, 11)) and all(a[1] > b[1] or a[1] == b[1] and a[2] < b[2] for a, b in zip(own, own[1:], strict=False))
        assert all(np.isclose(s, float(x[q].astype(float) @ x[v].astype(float)), rtol=1e-12) for _, s, v in own)


def test_exact_search_and_blocks(spark):
    rng = np.random.default_rng(17)
    x = np.round(rng.normal(size=(900, 12)), 1).astype(np.float32)
    x[500:] = x[:400]  # ties
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])
    want = brute(np.arange(900), x.astype(float), 7, 20)
    got = {}
    for r in nn.nearest(df, k=7, every=20, block=150, queries=10, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


@pytest.mark.parametrize("radius", [0, 6, 14, 64])
def test_tables_and_plain_comparison_agree(radius):
    rng = np.random.default_rng(radius)
    x = rng.normal(size=(500, 33))
    coder = nn.learn(x, 5, rotations=2)
    coder.radius = radius
    codes = coder.codes(x, False)
    far = np.bitwise_count(codes[:40, None] ^ codes[None]).sum(2, dtype=int)
    assert ((far <= radius) == nn.in_radius(coder, nn._tables(codes), codes, codes[:40])).all()


@needs_tables
def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, true = ({(r.query_id, r.vec_id) for r in nn.nearest(df, exact=exact).collect()} for exact in (False, True))
    assert len(got & true) / len(true) >= 0.9


def test_search_over_odd_rows_and_equal_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0]), (None, [1.0, 1.0]), (3, [None, 1.0]), (5, [float("inf"), 1.0]), *[(100 + i, [1.0, 1.0]) for i in range(30)]]
    out = nn.nearest(frame(spark, rows), k=20, every=20).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in out} == {0, 100, 120}
    assert [r.vec_id for r in out if r.query_id == 100] == list(range(101, 121))
    few = nn.nearest(frame(spark, rows[:1] + rows[-2:]), k=20, every=20).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 128), (0, 2, 129)]
    assert nn.nearest(frame(spark, []), k=20).count() == 0


def test_probing_retrieves_all_codes_in_the_radius():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 32))
    coder = nn.learn(x, 10)
    codes = coder.codes(x, False)
    own = nn.shares(coder.radius, codes.shape[1])
    dist = np.bitwise_count(codes[:, None] ^ codes[None]).astype(int)
    inside = dist.sum(2) <= coder.radius
    assert (inside <= (dist <= np.array(own)).any(2)).all() and inside.sum() > 300


# --- substrings
def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(11)
    shared = [passage(rng, 60) for _ in range(12)]
    rows, planted = [], {}
    for i in range(60):
        own = [passage(rng, rng.randint(5, 200)) for _ in range(2)]
        if i % 5 == 0:
            planted[i] = i // 5
        rows.append((i, f"{own[0]} {shared[i // 5]} {own[1]}" if i % 5 == 0 else " ".join(own)))
    rows += [(100 + k, f"{passage(rng, k + 1)} {s} end {passage(rng, 9)}") for k, s in enumerate(shared)]
    out = sd.repeated_spans(docs(spark, rows)).collect()
    assert {r.doc_id for r in out} == {100 + k for k in range(12)}
    for r in out:
        text = dict(rows)[r.doc_id].encode()
        source = dict(rows)[r.source_doc_id].encode()
        assert text[r.start : r.end] in source and planted[r.source_doc_id] == r.doc_id - 100
    cleaned = {r.doc_id: r.text for r in sd.drop_repeats(docs(spark, rows)).collect()}
    assert all(cleaned[i] == t for i, t in rows if i < 100) and all(len(cleaned[i]) < len(t) - 100 for i, t in rows if i >= 100)


def test_chunks_fall_in_step_after_an_insertion():
    rng = random.Random(12)
    text = passage(rng, 800).encode()
    for moved, by in ((b"inserted here " + text, 14), (text[:3000] + b"inserted here " + text[3000:], 14)):
        whole, other = set(zip(*map(np.ndarray.tolist, sd.chunks(text)), strict=True)), set(zip(*map(np.ndarray.tolist, sd.chunks(moved)), strict=True))
        kept = sum((h, s, e) in other or (h, s + by, e + by) in other for h, s, e in whole)
        assert kept >= len(whole) - 6
    _, start, end = sd.chunks(text)
    assert set(end - start) <= set(range(sd.LEAST, sd.MOST + 1)) and len(set(end - start)) > 3 and np.diff(end).max() <= sd.WINDOW


def test_chunks_against_brute_force():
    rng = random.Random(16)
    for text in (passage(rng, 120).encode(), "straße überall é".encode() * 9, bytes(rng.randrange(256) for _ in range(700)), b"x" * 39, b"x" * 40):
        def gear(i, n):
            h = 0
            for b in text[max(0, i - n + 1) : i + 1]:
                h = (h << 1) + int(sd.GEAR[b]) & 0xFFFFFFFF
            return h

        value = {i: gear(i, 32) for i in range(sd.DECIDE - 1, len(text))}
        ends = set()
        for i in range(sd.DECIDE - 1, max(sd.DECIDE, len(text) - sd.WINDOW + 1)):
            near = [j for j in range(i, min(i + sd.WINDOW, len(text)))]
            ends |= {j + 1 for j in near if value[j] == min(value[k] for k in near)}
        want = [(min(range(e - sd.MOST, e - sd.LEAST + 1), key=lambda s: (gear(s - 1, 4), s)), e) for e in sorted(ends)]
        h, start, end = sd.chunks(text)
        got = list(zip(start.tolist(), end.tolist(), strict=True))
        assert set(got) <= set(want)
        by = dict(zip(got, h.tolist(), strict=True))
        content = {}
        for s, e in got:
            assert content.setdefault(by[s, e], text[s:e]) == text[s:e]
        assert {text[s:e] for s, e in want} == {text[s:e] for s, e in got}  # left out are repeats only


@pytest.mark.parametrize("size", [101, 102, 180, 400])
def test_shared_bytes_share_a_chunk(size):
    rng = random.Random(size)
    found = 0
    for _ in range(300):
        p = bytes(rng.randrange(97, 123) for _ in range(size))
        a, b = (bytes(rng.randrange(97, 123) for _ in range(rng.randrange(300))) for _ in range(2))
        found += bool(set(sd.chunks(a + p + b)[0].tolist()) & set(sd.chunks(b + p + a)[0].tolist()))
    assert found == 300


def test_spans_against_brute_force(spark):
    rng = random.Random(17)
    shared = [passage(rng, rng.randint(30, 90)) for _ in range(5)]
    rows = []
    for i in range(30):
        parts = [passage(rng, rng.randint(0, 60)) for _ in range(3)] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((i, " | ".join(parts)))
    covered = {}
    for k, (i, t) in enumerate(rows):  # bytes of every run of MIN_SPAN or more that an earlier text holds too
        own = bytearray(len(t))
        for _, other in rows[:k]:
            for at in range(len(t) - sd.MIN_SPAN + 1):
                if t[at : at + sd.MIN_SPAN] in other:
                    own[at : at + sd.MIN_SPAN] = b"\1" * sd.MIN_SPAN
        covered[i] = own
    got = {i: bytearray(len(t)) for i, t in rows}
    for r in sd.repeated_spans(docs(spark, rows)).collect():
        got[r.doc_id][r.start : r.end] = b"\1" * (r.end - r.start)
    assert sum(map(sum, covered.values())) > 3000
    for i, own in covered.items():  # only the separators beside a passage may match another source than the smallest
        assert all(not c or any(got[i][max(0, k - 3) : k + 4]) for k, c in enumerate(own))
    assert all(not g or c for i in got for g, c in zip(got[i], covered[i], strict=True))  # no byte that isn't in such a run


def test_short_phrases_of_two_texts_side_by_side_are_no_repeat(spark):
    rng = random.Random(19)
    rows = []
    for i in range(40):
        a, b = passage(rng, 40)[:80], passage(rng, 40)[:80]
        rows += [(i, f"{passage(rng, 20)} {a} {passage(rng, 20)}"), (100 + i, f"{passage(rng, 20)} {b} {passage(rng, 20)}"), (200 + i, f"{passage(rng, 20)}{a}{b}{passage(rng, 20)}")]
    df = docs(spark, rows)
    assert sd.repeated_spans(df).count() == 0
    assert {r.doc_id: r.text for r in sd.drop_repeats(df).collect()} == dict(rows)


def test_rows_that_share_an_id_lose_only_their_own_repeats(spark):
    rng = random.Random(18)
    shared, other = passage(rng, 80), passage(rng, 300)
    rows = [(1, f"{passage(rng, 20)} {shared}"), (2, f"{shared} tail"), (2, other), (3, "é" * 40 + shared + "ß" * 40)]
    df = docs(spark, rows).withColumn("a.b", F.lit(1)).withColumn("_SPANS", F.lit(2))
    back = sd.drop_repeats(df)
    assert back.columns == df.columns
    texts = sorted((r.doc_id, r.text) for r in back.collect())
    assert (1, rows[0][1]) in texts and (2, other) in texts and (2, " tail") in texts and (3, "é" * 40 + "ß" * 40) in texts


def test_very_long_texts_of_one_word_take_few_chunks():
    for word in (b"x", b"the. ", b"longer words "):
        h, start, _ = sd.chunks(word * (2_000_000 // len(word)))
        assert len(set(h.tolist())) <= 62 and len(start) < 2_000_000 / 15


def test_substrings_of_odd_rows(spark):
    rng = random.Random(13)
    p = passage(rng, 80)
    rows = [*ODD, (9, p), (9, p), (None, p), (10, p + " é"), (11, "the. " * 20_000), (12, "the. " * 20_000)]
    out = sd.repeated_spans(docs(spark, rows)).collect()
    assert {r.doc_id for r in out} == {10, 12} and {r.source_doc_id for r in out} == {9, 11}
    assert sd.repeated_spans(docs(spark, [])).count() == 0
    back = sd.drop_repeats(docs(spark, rows))
    assert back.columns == docs(spark, rows).columns and back.count() == len(rows)


def test_passages_of_short_words_are_found_to_their_ends(spark):
    rng = random.Random(14)
    short = lambda n, most: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, most))) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        p = short(51, i % 3 + 1)
        before, after = passage(rng, rng.randint(1, 90)) + " <", "> " + passage(rng, rng.randint(1, 90))
        rows += [(i, f"{passage(rng, 40)} [{p}] {passage(rng, 30)}"), (1000 + i, before + p + after)]
        want[1000 + i] = (len(before), len(before) + len(p), i)
    out = sd.repeated_spans(docs(spark, rows)).collect()
    assert {r.doc_id: (r.start, r.end, r.source_doc_id) for r in out} == want and len(out) == 60


def test_repeats_inside_a_document(spark):
    rng = random.Random(15)
    p = passage(rng, 60)
    text = f"{p} <{passage(rng, 40)}> {p}"
    out = sd.repeated_spans(docs(spark, [(1, text), (2, passage(rng, 200))]), within=True).collect()
    assert [(r.doc_id, r.source_doc_id) for r in out] == [(1, 1)] and text[out[0].start : out[0].end].strip() == p


def test_samples_are_bounded_however_often_an_id_comes(spark):
    from helixframe.llm import language_id, toxicity

    words = {"en": "the cat and the dog", "de": "der Hund und die Katze"}
    df = spark.range(60_000).select(
        F.when(F.col("id") < 50_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
        F.concat(F.when(F.col("id") % 2 == 0, words["en"]).otherwise(words["de"]), F.lit(" "), F.col("id").cast("string")).alias("text"),
    )
    got = {}
    real = language_id.fit
    language_id.fit = lambda counts, langs: got.update(n=len(langs), each={x: langs.count(x) for x in langs}) or real(counts, langs)
    try:
        model = language_id.train(df, per_language=50)
    finally:
        language_id.fit = real
    assert got["n"] <= 100 and max(got["each"].values()) <= 50 and set(model.languages) == {"en", "de"}
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    real_fit = toxicity.fit
    toxicity.fit = lambda terms, y: got.update(terms=len(terms)) or real_fit(terms, y)
    try:
        toxicity.train(df, labels, per_class=30)
    finally:
        toxicity.fit = real_fit
    assert got["terms"] <= 60

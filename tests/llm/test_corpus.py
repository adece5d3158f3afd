"""Corpus operators against brute force, on small tables with every awkward row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netloom.llm import encoding, html_text, language, licenses, mixing, packing, queries, shingle_join, spans, suffix_dedup, suffix_sort, token_shards, vectors
from netloom.llm.html_text import extract_main_text, main_text

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component long, _size long"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", f"s{n % 3}" if n % 7 else None, len(t or ""), 1, 2) for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", "  \n", "one", "one two three four", "ONE two three four", "x " * 3000, "x " * 2999]
    for _ in range(20):
        base = words(rng, rng.randrange(30, 120)).split()
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    family = words(rng, 100).split()
    for k in range(30):
        out.append(" ".join(family[:50] + [f"v{k}"] + family[50:]))
    passage = words(rng, 60)
    out += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(12)]
    return out


def jaccard(texts, width=5, least=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def test_jaccard_join(spark, texts):
    got = sorted(tuple(r) for r in shingle_join.jaccard_components(table(spark, texts)).collect())
    assert got == jaccard(texts)


def test_jaccard_join_without_rows_and_ids(spark):
    assert shingle_join.jaccard_components(table(spark, [])).count() == 0
    got = shingle_join.jaccard_components(table(spark, ["a b c", "a b c", "a b c"], [4, None, 4])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 1, -1), (4, 1, 4), (4, 1, 4)]


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for size, top in ((0, 1), (1, 1 << 56), (1000, 1 << 56), (1000, 3)):
        values = np.sort(rng.integers(0, top, size).astype(np.uint64))
        assert (shingle_join.unpack(shingle_join.pack(values)) == values).all()


@pytest.mark.parametrize("block", [3, 2048])
def test_jaccard_join_of_a_large_family(spark, monkeypatch, block):
    """A third of all rows are near copies of one text, some linked by a chain only, in small and large chunks."""
    rng = random.Random(11)
    base = words(rng, 90, 5000).split()
    texts = [words(rng, rng.randrange(5, 90), 5000) for _ in range(300)] + [" ".join(base)] * 40
    for _ in range(160):
        copy = list(base)
        for _ in range(rng.randrange(1, 8)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(40)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    for name, value in (("LIST_BLOCK", block), ("PAIR_BLOCK", block), ("CHUNK", 50 * block), ("SLICE_BYTES", 1000 * block)):
        monkeypatch.setattr(shingle_join, name, value)
    got = sorted(tuple(r) for r in shingle_join.jaccard_components(table(spark, texts).repartition(5)).collect())
    assert got == jaccard(texts)


def test_jaccard_join_ids_of_several_texts(spark):
    """An id that stands for two texts joins what each of them links with."""
    a, b, c = ("one two three four five six", "red green blue white black grey", "north east south west up down")
    got = shingle_join.jaccard_components(table(spark, [a, b, a, b, c, None, "\x0b\x1c"], [9, 9, 3, 5, 8, 9, 7])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 2, 3), (5, 2, 3), (7, 1, 7), (8, 2, 8), (9, 0, 9), (9, 2, 3), (9, 2, 3)]


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Top of site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, a long notice that goes on and on for many words.</div>
<main><h1>Title &amp; more</h1><p>First   paragraph <b>bold</b>text.<p>Second &eacute; one<br>new line</p><script>no()</script><div class="ad">Buy!</div></main>
<aside>Side</aside><section id="comments"><p>A reader says a great many things here that are not the article at all.</p></section><form><p>Name</p></form><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    assert main_text(PAGE) == "Title & more First paragraph boldtext. Second é one new line"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain only"), (5, "x", "<p>unclosed <b>x"), (5, "x", "<p>unclosed <b>x")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_main_text(pages, "html", ["page_id", "url"]).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 5] and got[1][1:] == ("", 0) and got[3][1] == "plain only" and got[4][1] == "unclosed x"
    assert extract_main_text(pages.limit(0), "html").count() == 0
    long = "<article><p>" + "word " * 50_000 + "</p></article>"
    assert main_text(long) == ("word " * 50_000).strip()


def test_html_without_article_element():
    a, b, c, d = (f"{w} paragraph with a good many words of the story." for w in ("First", "Second", "Third", "Fourth"))
    assert main_text(f"<body><h1>T</h1><p>{a}</p><p>{b}</p></body>") == f"T {a} {b}"
    assert main_text("<body><h1>T</h1><p>A</p><p>B</p></body>") == "T A B"
    split = main_text(f"<body><div><p>{a}</p><p>{b}</p><p>{c}</p></div><div class='ad'>Buy</div><h2>More</h2><div><p>{c}</p><p>{d}</p></div></body>")
    assert split == f"{a} {b} {c} More {c} {d}"
    assert main_text(f"<body><div>{a * 4}<div><p>{b}</p><p>{c}</p><p>{d}</p></div></div></body>") == f"{a * 4} {b} {c} {d}"


@pytest.mark.parametrize("thin", ["<article><p>A teaser.</p></article>", "<main><h2>Latest</h2></main>"])
def test_html_density_outweighs_article_element(thin):
    story = [f"Paragraph {n} of the story, with a good many words in it." for n in range(6)]
    got = main_text(f"<body>{thin}<div class='text'>{''.join(f'<p>{p}</p>' for p in story)}</div></body>")
    assert got.endswith(" ".join(story))


@pytest.mark.parametrize("name", ['class="content with-sidebar"', 'id="page" class="header-fixed"', 'class="share-enabled post"', "role=form"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_html_wrappers_named_like_boilerplate(name, inner):
    story = [f"Paragraph {n} of the story, with a good many words in it." for n in range(4)]
    page = f"<body><div {name}><{inner}>{''.join(f'<p>{p}</p>' for p in story)}</{inner}><div class='sidebar'><p>Side text.</p></div></div><div class='related'><p>Elsewhere</p></div></body>"
    assert main_text(page) == " ".join(story)


def test_html_cuts_a_bare_advert_longer_than_the_text():
    assert main_text(f"<body><div class='ad'>{'Buy now. ' * 40}</div><article><h1>T</h1><p>Short.</p></article></body>") == "T Short."


def test_html_keeps_paragraphs_beside_a_bold_one():
    page = f"<body><div><h1>T</h1><p><b>{'long bold text ' * 60}<br></b></p><p>Short one.</p></div></body>"
    assert main_text(page) == f"T {('long bold text ' * 60).strip()} Short one."


def test_html_character_references():
    assert main_text(f"<p>a &#{'9' * 5000}; b &#x{'f' * 5000} c &#{'0' * 5000}65; &#x41; &eacute;</p>") == "a \ufffd b \ufffd c A A é"


@pytest.mark.parametrize("junk", ["<a '", '<a b="x', "<a b='>' ", "<div>", "</span>", "<b><p>x", "<script></script ", "<!x", "<!--", "<li><b>x", "&#"])
def test_html_reads_broken_pages_in_linear_time(junk):
    page = "<body><p>Hello world.</p>" + junk * 30_000
    begin = time.process_time()
    assert main_text(page).startswith("Hello world.")
    assert time.process_time() - begin < 5


def test_html_columns_of_the_same_names(spark):
    pages = spark.createDataFrame([(1, "old", "<p>new</p>", 7, 2)], "page_id long, text string, html string, n_chars int, `a.b` int")
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "a.b", "text", "n_chars"] and [tuple(r) for r in got.collect()] == [(1, 2, "new", 3)]


def test_html_words_that_also_name_parts_of_an_article():
    story = [f"Paragraph {n} of the story, with a good many words in it." for n in range(6)]
    links = "<ul><li><a href=a>One place</a></li><li><a href=b>Another place</a></li><li><a href=c>A third</a></li></ul>"
    page = f"<body><article><div class='entry-header'><h1>Headline</h1></div>{''.join(f'<p>{p}</p>' for p in story[:3])}{links}<div class='social-history'><p>{story[3] * 3}</p></div><div class='social-share'><a href=x>Post</a> <a href=y>Mail</a></div></article><div class='post-comments'><p>{story[5]}</p></div></body>"
    assert main_text(page) == " ".join(["Headline", *story[:3], "One place Another place A third", story[3] * 3])


def densities(node, whole, linked):
    """Composite text density and density sum of a node, by the definition; a node is its tag and a list of texts and nodes."""
    def counts(x):
        if isinstance(x, str):
            return np.array([len(x), 0, 0, 0])
        own = sum((counts(c) for c in x[1]), np.zeros(4, int)) + np.array([0, sum(not isinstance(c, str) for c in x[1]), 0, sum(c[0] == "a" for c in x[1] if not isinstance(c, str))])
        if x[0] == "a":
            own[2] = own[0]
        return own

    def density(x):
        c, t, lc, lt = counts(x).tolist()
        t, lt = max(t, 1), max(lt, 1)
        return 0.0 if not c else c / t * math.log(c * t / (max(lc, 1) * lt) + 1) / math.log(math.log(c * lc / max(c - lc, 1) + linked * c / max(whole, 1) + math.e) + 1)

    return density(node), sum(density(c) for c in node[1] if not isinstance(c, str))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000))
def test_html_densities_are_those_of_the_definition(seed):
    """Pages without article and main elements: densities, and what the threshold on the way from the largest sum to the body keeps."""
    rng = random.Random(seed)

    def block(depth):
        kind = rng.choice(["div", "section", "p"]) if depth else "p"
        if kind == "p":
            return ("p", [w if rng.random() < 0.8 else ("a", [w]) for w in (f"{k}" + "word" * rng.randrange(1, 40) for k in range(rng.randrange(1, 4)))])
        return (kind, [block(depth - 1) for _ in range(rng.randrange(1, 4))])

    body = ("body", [block(3) for _ in range(rng.randrange(1, 5))])

    def text(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(text, x[1]))}</{x[0]}>"

    root = html_text.parse(text(body))
    top, whole = html_text._measure(root)
    linked = top.link_chars
    nodes, stack = {}, [(top, body, None)]
    while stack:
        node, x, parent = stack.pop()
        nodes[id(node)] = (node, x, parent)
        d, total = densities(x, whole, linked)
        assert math.isclose(node.density, d) and math.isclose(node.total, total, abs_tol=1e-12)
        stack.extend((c, y, node) for c, y in zip(node.children, x[1]) if not isinstance(y, str))
    core = top.peak
    assert math.isclose(core.total, max(n.total for n, _, _ in nodes.values()))
    while core is not top and core.tag in ("p", "a"):
        core = core.parent
    threshold, node = core.density, core
    while node is not top:
        node = node.parent
        threshold = min(threshold, node.density)
    html_text._keep(top)
    inside = lambda n: n.kept or (n is not top and inside(n.parent))
    for node, _, _ in nodes.values():
        if node.chars and node.density >= threshold and node.tag not in ("p", "a"):
            assert inside(node) or any(n.kept for n, _, _ in nodes.values() if n is not node and is_below(n, node))
        if node.kept and node is not core:
            assert any(n.density >= threshold for n, _, _ in nodes.values() if n is node or is_above(n, node) or is_below(n, node))
    assert inside(core)


def is_above(x, node):
    while node.parent is not None:
        node = node.parent
        if node is x:
            return True
    return False


def is_below(x, node):
    return is_above(node, x)


@settings(max_examples=150, deadline=None)
@given(st.text("<>/ab p&;\"'!-=", max_size=60))
def test_html_never_fails(page):
    assert main_text(page) == " ".join(main_text(page).split())


def test_language(spark):
    rng = random.Random(1)
    english, german = "the and of to in that with from have this they were".split(), "der und die das ist nicht mit auf für eine über schön".split()
    rows = [(i, " ".join(rng.choice(english if i % 2 else german) for _ in range(30)), "en" if i % 2 else "de", None, 0, 0, 0) for i in range(120)]
    docs = spark.createDataFrame([*rows, (900, None, "en", None, 0, 0, 0), (901, "12 34 !", None, None, 0, 0, 0), (902, "", "de", None, 0, 0, 0)], DOCS)
    model = language.train_prototypes(docs.where(~language.held_out()))
    got = {r.doc_id: r for r in language.identify_language(docs, model).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert {r.held for r in docs.select(language.held_out().alias("held")).distinct().collect()} == {True, False}
    nothing = language.identify_language(docs, language.train_prototypes(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    letters = language.letter_vectors()
    codes = language.trigram_codes("abcab")
    assert np.allclose(language.profiles(["abcab"], letters)[0], language.trigram_vectors(codes, letters).astype(float).sum(0))


def test_language_is_that_of_a_naive_classifier(spark):
    """Vectors bound and bundled one trigram at a time, in Python; more languages than a task holds; clashing names."""
    rng = random.Random(4)
    letters = language.letter_vectors().astype(int)
    langs = [f"l{k:02}" for k in range(language.HELD_LANGUAGES + 5)]
    alphabet = {lang: rng.sample("abcdefghijklmnopqrstuvwxyzéüßжи", 9) for lang in langs}
    say = lambda lang: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(25))
    known = [(say(lang), lang) for lang in langs for _ in range(3)]
    asked = [*(say(lang) + "!?" for lang in langs), None, "", "12 ..", "a", "É " * 30]

    def profile(text):
        out, symbols = np.zeros(language.DIMENSIONS, int), [0]
        for ch in text or "":
            k = int(language._symbols(ch)[0])
            if k or symbols[-1]:
                symbols.append(k)
        symbols += [0] if symbols[-1] else []
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            out += letters[0][a] * letters[1][b] * letters[2][c]
        return out

    prototypes = {lang: sum(profile(t) for t, own in known if own == lang) for lang in langs}
    docs = spark.createDataFrame([(n, t, "x", 0.5) for n, t in enumerate(asked)], "doc_id long, text string, lang_pred string, score double")
    model = language.train_prototypes(spark.createDataFrame(known, "text string, lang string").repartition(3))
    assert sorted(model) == langs
    found = language.identify_language(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    for r in found.collect():
        own = profile(asked[r.doc_id])
        if not own.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {lang: float(own @ p / (np.linalg.norm(own) * np.linalg.norm(p))) for lang, p in prototypes.items()}
        assert cosine[r.lang_pred] > max(cosine.values()) - 1e-5 and abs(r.score - max(0.0, cosine[r.lang_pred])) < 1e-5


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40:60] = x[40]
    rows = [(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)] + [(50_000, None, 0), (50_050, [1.0, None], 0), (50_100, [float("nan")] * 8, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in vectors.exact_top_k(frame, 5, 50, 256, pivots=7).collect())
    ints = np.floor(x.astype(float) * 256).astype(np.int64)
    want = []
    for q in range(0, 300, 50):
        s = ints @ ints[q]
        order = [j for j in np.lexsort((np.arange(300), -s)).tolist() if j != q][:5]
        want += [(q, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert got == sorted(want)
    assert vectors.exact_top_k(frame.limit(0)).count() == 0
    assert vectors.exact_top_k(frame.where("vec_id < 3")).count() == 2
    assert vectors.exact_top_k(frame.where("vec_id = 1")).count() == 0


def test_top_k_with_repeated_and_null_ids_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [3.0]), (None, [9.0, 9.0]), (50, [2.0]), (7, [])]
    got = sorted(tuple(r) for r in vectors.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 50, 2).collect())
    assert got == [(0, 1, 1, 8), (0, 2, 1, 8), (50, 1, 2, 24)]


def test_top_k_prunes_clustered_vectors(spark):
    """Groups of queries far apart: a row goes to its own group only, and results stay exact."""
    rng = np.random.default_rng(8)
    centers = np.eye(6) * 40
    x = np.concatenate([c + rng.normal(scale=0.2, size=(60, 6)) for c in centers])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.exact_top_k(frame, 3, 10, 16, pivots=6).collect())
    ints = np.floor(x * 16).astype(np.int64)
    want = []
    for q in range(0, 360, 10):
        s = ints @ ints[q]
        want += [(q, k + 1, j, int(s[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(360), -s)).tolist() if j != q][:3])]
    assert got == sorted(want)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    x[50:80] = x[50] + rng.normal(scale=0.08, size=(30, 6))
    x[90:100] = x[90]
    labels = [int(v) for v in rng.integers(0, 2, 200)]
    rows = [(i, [float(v) for v in r], labels[i]) for i, r in enumerate(x)] + [(500, None, 1), (501, [0.0] * 6, 1), (502, [1.0] * 6, None), (503, [float("inf")] * 6, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicate_vectors(frame, pivots=9).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    reach = np.linalg.matrix_power(near.astype(float), 1) > 0
    for _ in range(8):
        reach = (reach.astype(float) @ reach.astype(float)) > 0
    for i in range(200):
        r = got[i]
        assert (r.n_links, r.component_id, r.kept) == (near[i].sum() - 1, int(reach[i].argmax()), int(reach[i].argmax()) == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (500, 501, 502, 503))
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (2, [0.0, 3.0], 1), (9, [1.0], 1), (8, [0.1, 3.0], 1)], "vec_id long, embedding array<double>, label int")
    found = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(odd).collect())
    assert found == [(-1, 0, None, True), (2, 1, 2, True), (4, 1, 4, True), (4, 1, 4, True), (8, 1, 2, False), (9, 0, 9, True)]
    assert vectors.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_mixing(spark, texts):
    docs = table(spark, [*texts, *texts[8:12]])
    got = mixing.mix_sources(docs).toPandas()
    base = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    base.register("documents", documents)
    want = base.execute(mixing.mixing_sql("documents")).fetchdf()
    key = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    assert sorted(map(tuple, got[key].round(6).astype(float).values.tolist())) == sorted(map(tuple, want[key].round(6).astype(float).values.tolist()))
    assert (got.taken <= 3 * got["size"]).all()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == int(got[got["size"] > 0].copies.sum())
    odd = docs.withColumnsRenamed({"lang": "row", "n_chars": "target", "component": "whole"}).withColumn("copies", F.lit("own")).withColumn("last", F.lit(1)).withColumn("a.b`c", F.col("doc_id"))
    again = mixing.mixed_documents(odd).toPandas()
    assert list(again.columns) == odd.columns and set(again["_size"]) == {2} and set(again["copies"]) == {"own"} and (again["a.b`c"] == again["doc_id"]).all()
    assert sorted(again["doc_id"]) == sorted(r.doc_id for r in mixed.collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(table(spark, [None, ""])).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aBé ßÉ\n\t.!'s1x—\x0b", max_size=30), max_size=6))
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_is_the_library(name, batch):
    coder = encoding.encoder(public_tokenizers.path(name))
    want = [t.ids for t in coder.tokenizer.encode_batch(batch, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in coder.encode(batch)] == want
    assert coder.encode([None]) == [b""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "hello", " ", "'", "É", "—", "<|", "1"]), max_size=8).map("".join), max_size=6))
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_are_those_of_a_fresh_library(name, batch):
    coder, fresh = encoding.encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    batch = [*batch, "hello <|endoftext|> world", "a'<|ENDOFTEXT|>"]
    want = [t.ids for t in fresh.encode_batch(batch, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in coder.encode(batch)] == want


def test_token_shards(spark, texts):
    ids = list(range(len(texts)))
    ids[5] = ids[4]
    docs = table(spark, [*texts, "for null"], [*ids, None])
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_shards.token_id_output(spark, docs, path, 1).collect()
    coder, at = Tokenizer.from_file(path), 0
    want = []
    order = sorted(zip([*ids, None], [*texts, "for null"]), key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or ""))
    for key, text in order:
        found = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((key, at, len(found), zlib.crc32(struct.pack(f"<{len(found)}I", *found))))
        at += len(found)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_shards.token_id_output(spark, docs.limit(0), path, 1).count() == 0


def test_ids_of_one_key(spark, texts, tmp_path, monkeypatch):
    """Through the manifest and the index, with keys that go on in the next shard."""
    monkeypatch.setattr(token_shards, "SHARD_IDS", 1)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = [*range(len(texts)), *[7] * 2500]
    manifest = token_shards.write_token_shards(table(spark, [*texts, *[f"text {k:05}" for k in range(2500)]], ids), str(tmp_path), path, 1)
    coder = Tokenizer.from_file(path)
    for key in (0, 4, len(texts) - 1):
        assert token_shards.ids_of_key(manifest, str(tmp_path), key).tolist() == [*coder.encode(texts[key] or "", add_special_tokens=False).ids, 1]
    assert token_shards.ids_of_key(manifest, str(tmp_path), 7, 2000).tolist() == [*coder.encode("text 02000", add_special_tokens=False).ids, 1]
    assert token_shards.ids_of_key(manifest, str(tmp_path), 7, 2501) is None and token_shards.ids_of_key(manifest, str(tmp_path), -1) is None


def test_shard_index():
    keys = np.sort(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000))
    shard = token_shards.TokenShard(token_shards.shard_bytes(keys, [struct.pack("<I", k) for k in range(5000)], 4))
    assert (shard.find(keys, np.zeros(5000, np.int64)) == np.arange(5000)).all()
    assert (shard.find(keys + 1, np.zeros(5000, np.int64)) >= 0).mean() < 0.01
    assert shard.ids_of(17).tolist() == [17]


def test_packing(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.best_fit_packing(table(spark, texts), path, 2, 64).toPandas()
    coder = Tokenizer.from_file(path)
    for key, own in got.groupby("doc_id"):
        ids = [*coder.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        own = own.sort_values("piece")
        assert own.length.sum() == len(ids) and (own.start == own.length.cumsum() - own.length).all() and (own.length.iloc[1:] == 64).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
    assert set(got.doc_id) == set(range(len(texts)))
    bins = got.sort_values(["sequence_id", "offset"])
    assert (bins.groupby("sequence_id").length.cumsum() - bins.length == bins.offset).all() and bins.groupby("sequence_id").length.sum().max() <= 64
    assert bins.sequence_id.nunique() <= -(-got.length.sum() // 64) * 1.05 + 1
    assert packing.best_fit_packing(table(spark, []), path, 2).count() == 0


def test_packing_equal_rows_nulls_and_the_rule(spark, monkeypatch):
    """Equal rows spread over the groups; bins are those of a naive search for the smallest sum of squares."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    rows = packing.pack(packing.materialize(packing.cut_pieces(table(spark, [None] * 3000, [None] * 3000), path, 2, 64), "pieces"), 64, 100).collect()
    assert len(rows) == 3000 and len({r.sequence_id >> 36 for r in rows}) == 30 and {r.doc_id for r in rows} == {None}
    rng = np.random.default_rng(5)
    for capacity, top in ((20, 20), (20, 7), (64, 64)):
        sizes = rng.integers(1, top + 1, 150)
        bins, offsets = packing.sum_of_squares(sizes, capacity)
        gaps: list[int] = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            s = int(sizes[i])

            def squares(changed):
                count = np.bincount([g for g in changed if 0 < g < capacity], minlength=capacity)
                return int((count.astype(int) ** 2).sum())

            options = [(squares([g - s if b == k else g for k, g in enumerate(gaps)]), gap, b) for b, gap in enumerate(gaps) if gap >= s]
            gap = min(options)[1] if options else capacity
            assert offsets[i] == capacity - gap
            if options:
                assert gaps[bins[i]] == gap
                gaps[bins[i]] -= s
            else:
                assert bins[i] == len(gaps)
                gaps.append(capacity - s)


def test_licenses(spark):
    rows = ["The MIT License, mit license MIT\nLicense", None, "", "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0", "GNU General Public License", "amit license", "é mit license"]
    got = [r for r in licenses.license_scan(table(spark, rows)).orderBy("doc_id").collect()]
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (7, 3, 1, 5, "mit")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels) == (0, 0, None, "")
    assert got[3].labels == "spdx:apache-2.0,spdx:gpl-2.0-only-with-classpath-exception-2.0,spdx:mit" and got[3].score == 1.0
    assert got[4].labels == "gpl,notice:gpl" and got[5].n_base == 0 and got[6].first_word == 1
    assert licenses.evaluate("mit and gpl-3.0 or isc")[1] == 1.0 and licenses.evaluate("mit and (gpl-3.0 or agpl-3.0)")[1] == 0.3 and licenses.evaluate(") or") is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "apache", "general", "public", "GNU", "x", "é", " ", "\n", "-", "_", "licenses", "license.", "all rights reserved"]), max_size=40).map(" ".join))
def test_license_words_and_places(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    places = [(k, label) for k in range(len(found)) for phrase, label in licenses.BASE_PHRASES.items() if found[k : k + len(phrase.split())] == phrase.split()]
    got = licenses.scan_text(text)
    assert got[:2] == (len(found), len(places))
    assert got[2:4] == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
    assert got[4] == ",".join(sorted({label for _, label in places})) and 0 <= got[6] <= 1


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.sampled_from(["mit", "isc", "gpl-2.0", "mpl-2.0", "foo"]), lambda x: st.tuples(x, st.sampled_from(["and", "or"]), x), max_leaves=12))
def test_license_expressions(tree):
    def text(x):
        return x if isinstance(x, str) else f"({text(x[0])} {x[1]} {text(x[2])})"

    def value(x):
        if isinstance(x, str):
            return {x}, licenses.freedom(x)
        (a, s), (b, t) = value(x[0]), value(x[2])
        return a | b, (max if x[1] == "or" else min)(s, t)

    assert licenses.evaluate(text(tree)) == value(tree)


@pytest.mark.parametrize("line", ["mit license ", "spdx-license-identifier: mit ", "spdx-license-identifier: ( ", "a or mit and "])
def test_license_scan_takes_linear_time(line):
    begin = time.process_time()
    licenses.scan_text("SPDX-License-Identifier: " + line * 60_000)
    assert time.process_time() - begin < 5


def repeats(docs, length=100):
    seen, out = set(), []
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(raw[k : k + length])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if raw else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, texts, monkeypatch):
    more = [*texts, "ab" * 400, "é" * 120 + "x" + "é" * 130, texts[20] + texts[21], texts[20][:99], texts[20][1:101]]
    docs = table(spark, more)
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == repeats(list(enumerate(more)))
    kept = suffix_dedup.remove_repeats(docs, keep=docs.columns)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == len(more)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    monkeypatch.setattr(suffix_dedup, "HOT_PARTS", 1)
    assert sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs.repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == got
    twice = suffix_dedup.remove_repeats(table(spark, [texts[20], texts[20]], [3, 3])).collect()
    assert sorted(r.n_removed for r in twice) == [0, len(texts[20])]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=6), st.sampled_from([4, 20]), st.sampled_from([8, 1 << 20]), st.sampled_from([3, 1 << 20]))
def test_induced_sorting(parts, cap, memory, block):
    raw = b"\0".join(p.encode() for p in parts) + b"\0"
    order, common = [], []
    for at, c in suffix_sort.InducedSorter(np.frombuffer(raw, np.uint8), cap, memory, block).sort():
        order += at.tolist()
        common += c.tolist()
    assert sorted(order) == list(range(len(raw)))
    for k in range(1, len(order)):
        x, y = (raw[o : raw.index(b"\0", o) + 1][:cap] for o in (order[k - 1], order[k]))
        same = next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert x <= y and (common[k] == same or same == min(len(x), len(y)) and common[k] >= same - 1)


@pytest.mark.parametrize("block", [30, 1 << 20])
def test_window_hashes(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", block)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 500).astype(np.uint8).tobytes()
    origin, windows = np.array([3, 40, 200]), np.array([5, 1, 80])
    got = suffix_dedup.window_hashes(data, origin, windows, 10)
    want = [data[o + k : o + k + 10] for o, w in zip(origin, windows) for k in range(w)]
    assert len(got) == 86 and all((got[i] == got[j]) == (want[i] == want[j]) for i in range(86) for j in range(i))


def test_spans():
    data, begins = spans.join_texts([b"aa bb", b"", b"cc"])
    starts, ends = spans.word_spans(data)
    assert [data[a:b] for a, b in zip(starts, ends)] == [b"aa", b"bb", b"cc"] and begins.tolist() == [0, 6, 7, 10]
    h = spans.hash_spans(data, starts, ends)
    assert len(set(h.tolist())) == 3


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    docs = table(spark, texts).drop("component", "_size")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = stages["ngram_jaccard_join"](spark, source, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in jaccard(texts) if i == c]
    cut = stages["suffix_array_dedup"](spark, source, str(tmp_path))
    assert cut.columns == source.columns
    lengths = {i: n - gone for i, n, gone, _, _ in repeats(list(enumerate(texts)))}
    assert all(len((r.text or "").encode()) == lengths[r.doc_id] for r in cut.collect())
    spoken = stages["language_id"](spark, source, str(tmp_path)).collect()
    assert {r.doc_id for r in spoken} >= {i for i, t in enumerate(texts) if t and t.strip()} and all(r.text.strip() for r in spoken)


def without_repeats(docs, length=100):
    seen, out = set(), []
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(raw[k : k + length])
        out.append((i, np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


def test_pipeline_from_end_to_end(spark, texts, tmp_path):
    """Every stage by brute force on what the one before kept; the last one's pieces are the mix's tokens."""
    import corpus_pipeline

    docs = table(spark, texts).drop("component", "_size")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    spoken = [(i, t) for i, t in enumerate(texts) if t and re.search("[^\\W\\d_]", t)]
    own = jaccard([t for _, t in spoken])
    kept = without_repeats([spoken[k] for k, _, c in own if k == c])
    source = {r.doc_id: r.source for r in docs.collect()}
    base = duckdb.connect()
    base.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    base.executemany("insert into documents values (?, ?, ?)", [(i, t, source[i]) for i, t in kept])
    taken = base.execute(f"select doc_id, copies from ({mixing.mixing_sql('documents')}) where size > 0").fetchall()
    coder, text_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), dict(kept)
    want = []
    for i, copies in taken:
        ids = [*coder.encode(text_of[i], add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] * copies
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    placed = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    for (s, a, n), (t, b, m) in zip([(None, 0, 0), *placed], placed):
        assert b == (a + n if s == t else 0) and b + m <= 1024


def test_stages_with_odd_ids_and_names(spark):
    """Null and repeated ids, no ``n_chars``, names that the operators use themselves."""
    import corpus_pipeline

    rng = random.Random(2)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(7, a), (7, b), (None, a + " x"), (8, b), (9, None), (9, ""), (10, "12 3"), (7, b)]
    names = ["lang_pred", "score", "row", "_id", "repeats_kept_text", "size", "place", "whole", "copies", "component_id", "order", "a.b"]
    docs = spark.createDataFrame([(i, t, "en", "s", *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, "")
        assert found.columns == docs.columns, name
        assert {tuple(r)[4:] for r in found.collect()} <= {tuple(range(len(names)))}
        assert stage(spark, docs.limit(0), "").count() == 0
    kept = sorted(((r.doc_id or -1), r.text or "") for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert kept == sorted([(7, a), (7, b), (9, ""), (9, ""), (10, "12 3")])
    assert sorted((r.text or "") for r in corpus_pipeline.language_stage(spark, docs, "").collect()) == sorted([a, b, b, b, a + " x"])


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} and names >= set(queries.QUERIES) | {"pipeline"}


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<b><table><tr><td>" + "<span>" * n + "</b>" * n,
        lambda n: "<ul><li><div>" + "<span>" * n + "<li></li>" * n,
        lambda n: "<div>" * n + "<span>" * n + "text " * 50 + "</span>" * n,
        lambda n: "<p>" + "<b>" * n + "<div>x</div>" * n,
        lambda n: "<table>" + "<tr><td>x" * n,
    ],
)
def test_pages_of_many_open_elements_take_linear_time(page):
    start = time.process_time()
    main_text(page(60_000))
    assert time.process_time() - start < 15


REMARK = "<p>" + "I think that this is a long remark about it. " * 20 + "</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><h1>T</h1><p>Tiny story here.</p></article><section><h2>Comments</h2><article class="comment">{REMARK}</article><article class="comment"><p>More</p></article></section>', "T Tiny story here."),
        (f"<main><h1>T</h1><p>Tiny story.</p><section><h2>3 Comments</h2><article>{REMARK}</article></section></main>", "T Tiny story."),
        (f'<article><h1>T</h1><p>Story.</p><article class="comment even depth-1">{REMARK}</article></article>', "T Story."),
        (f'<article><h1>T</h1><p>Story.</p><div itemprop="comment">{REMARK}</div></article>', "T Story."),
        (f'<article><h1>T</h1><p>Short story.</p><div class="newsletter">{REMARK}</div><p>End of it.</p></article>', "T Short story. End of it."),
        (f'<article><h1>T</h1><p>Short story.</p><div class="ad-banner">{REMARK}</div></article>', "T Short story."),
        (f'<div class="post"><h1>T</h1><p>Short story.</p></div><div id="comments"><div class="comment">{REMARK}</div></div>', "T Short story."),
        # What may be the article itself stays: a lone article with such a name, wrappers of all text, weak words, headings inside of an article.
        ('<article class="comment"><h1>T</h1><p>Only article here.</p></article>', "T Only article here."),
        ('<div class="newsletter"><h1>T</h1><p>Whole page here.</p></div>', "T Whole page here."),
        ('<article class="post comments-open"><h1>T</h1><p>Story of the day.</p></article>', "T Story of the day."),
        ('<article><h1>T</h1><p>Story of the day.</p><section><h2>Comments</h2><p>On the law.</p></section></article>', "T Story of the day. Comments On the law."),
    ],
)
def test_comments_and_adverts_of_any_length(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_licence_lines_of_many_tags_take_linear_time():
    tag = "SPDX-License-Identifier:"
    for text in (f"{tag}x or " * 60_000, f"{tag} x" + " with y" * 60_000, tag * 60_000, f"{tag} " + "(" * 60_000 + "x" + ")" * 60_000 + " or y", f"{tag} " + "x with (a or b) and " * 30_000 + "z"):
        start = time.process_time()
        licenses.scan_text(text)
        assert time.process_time() - start < 8


def test_licence_expressions_end_at_the_next_tag():
    found = licenses.scan_text("SPDX-License-Identifier: MIT or SPDX-License-Identifier: GPL-2.0 with Bison with Font\nSPDX-License-Identifier: (ISC and Zlib)")
    assert found[6] == 0.3 and found[5] == "spdx:gpl-2.0-with-bison-with-font,spdx:isc,spdx:mit,spdx:zlib"

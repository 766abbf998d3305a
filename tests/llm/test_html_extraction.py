import html
import itertools
import re
import time

import numpy as np
import pytest

from factorweave.llm import html_extraction as he
from factorweave.llm.labelled_pages import labelled_pages, made_page


def labelled(seeds):
    return [(b := he.blocks_of(h), he.aligned(b, text)) for h, text in map(made_page, seeds)]


@pytest.fixture(scope="session")
def model():
    return he.fit(labelled(range(20_000, 21_200)))


def text_of(model, page):
    blocks = he.blocks_of(page, frozenset(model.weights))
    return "\n\n".join(b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep)


def test_blocks():
    texts = lambda page: [b.text for b in he.blocks_of(page)]
    assert texts("<p>a &amp; b<br>c\n d&nbsp;e<p>f") == ["a & b c d e", "f"]
    assert texts("x<script>var t='</p><p>no';</script>y<style>p{}</style><!-- no <p>no --> z") == ["xy z"]
    assert texts("<head><title>no</title>no</head><ul><li>a<li>b</ul>c <b>d</b><i>e</i>") == ["a", "b", "c de"]
    assert texts('<a title="x > y">a</a> < b &lt;p&gt; <3 </> <!x> <?y> c') == ["a < b <p> <3 c"]
    assert texts("<p>a<!-- never closed <p>b") == ["a"]
    assert texts('<p>a<b class="never closed> <p>b') == ["a"]
    assert texts("<p>a<script>never closed <p>b") == ["a"]
    assert texts("<head><title>t</title><body><p>a</div></nav>b") == ["a", "b"]
    assert texts(None) == texts("") == texts("<p> \n</p>") == []
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<svg><title>no</title><p>no</p></svg>a<template><p>no</p></template>b") == ["ab"]


def test_ancestors_and_names():
    (a, b) = he.blocks_of('<nav class="topMenu main_nav"><p>a</p></nav><p id=x>b')
    assert {"a=nav", "a=p", "c=top", "c=menu", "c=main", "near:c=nav", "near:a=nav"} <= a.features
    assert "a=nav" not in b.features and "c=x" in b.features
    assert "hidden" in he.blocks_of('<div style="display:none">a')[0].features


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "a", "<div>a" * 60_000, '<a "' * 60_000, "<" * 200_000, "<p>" + "x " * 500_000, "<script>" * 40_000, "<!--" * 60_000, "<li>a" * 60_000, "</p>" * 100_000, "<svg>" * 60_000])
def test_linear_in_the_page(page, model):
    began = time.time()
    he.blocks_of(page, frozenset(model.weights))
    assert time.time() - began < 10


def test_viterbi_is_the_best_of_all_paths(model):
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        names = [f"f{i}" for i in range(n)]
        m = he.Model(dict(zip(names, rng.normal(size=n).tolist(), strict=True)), rng.normal(size=2), rng.normal(size=(2, 2)))
        score = lambda y: m.start[y[0]] + sum(m.weights[f] * k for f, k in zip(names, y, strict=True)) + sum(m.step[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert m.decode([he.Block("", frozenset([f])) for f in names]) == [bool(k) for k in best]


def test_likelihood_against_all_paths_and_its_gradient():
    pages = [(b[:6], y[:6]) for b, y in labelled(range(8)) if b]
    place = {f: i for i, f in enumerate(sorted({f for b, _ in pages for x in b for f in x.features}))}
    chains = he._Chains(pages, place)
    x = np.random.default_rng(4).normal(size=len(place) + 6) * 0.3
    w, start, step = x[:-6], x[-6:-4], x[-4:].reshape(2, 2)
    want = 0.0
    for blocks, labels in pages:
        own = [sum(w[place[f]] for f in b.features) for b in blocks]
        score = lambda y: start[y[0]] + sum(s * k for s, k in zip(own, y, strict=True)) + sum(step[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        want += np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=len(blocks)))) - score([int(k) for k in labels])
    value, grad = chains.loss(x)
    assert value == pytest.approx(want)
    for i in [*range(0, len(x), 17), *range(len(x) - 6, len(x))]:
        d = np.zeros(len(x))
        d[i] = 1e-5
        assert grad[i] == pytest.approx((chains.loss(x + d)[0] - chains.loss(x - d)[0]) / 2e-5, abs=1e-4)


def test_held_out_accuracy(model):
    right = total = 0
    for blocks, labels in labelled(range(300)):
        right += sum(a == b for a, b in zip(model.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right / total > 0.997


MAIN = "<h1>On rivers</h1><p>Rivers carry sand, and sand makes beaches.</p><p>Short.</p><ul><li>The first river is long, they say.</li></ul>"
WANTED = "On rivers\n\nRivers carry sand, and sand makes beaches.\n\nShort.\n\nThe first river is long, they say."


@pytest.mark.parametrize(
    "page",
    [
        "<nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav><article>{}</article><footer>&copy; 2024 Rivers, all rights reserved.</footer>",
        '<header><div class="logo">River site</div></header><main>{}</main><aside><h3>Popular</h3><p>Ten things about lakes.</p></aside>',
        '<div class="cookie-notice"><p>We use cookies, as all do. By reading on you agree.</p></div><article>{}</article>',
        '<div class="advert"><p>Buy boats, cheap boats, today.</p></div><article>{}<div class="ad"><p>Buy more boats now.</p></div></article>',
        '<article>{}</article><section class="comments"><h3>Comments</h3><p>I like rivers, but lakes are better.</p><p>No, seas are.</p></section>',
        '<article>{}<div id="comments"><p>I like rivers, but lakes are better.</p></div></article>',
        '<form class="search"><label>Search</label><button>Go</button></form><article>{}</article><form><p>Give us your address, we send news.</p><button>Send</button></form>',
        '<div class="sidebar"><p>About the writer, who lives by a river.</p></div><div class="content">{}</div>',
        '<script>if (a < b) {{ x("<p>no</p>") }}</script><style>p {{ margin: 0 }}</style><article>{}</article><!-- <p>no</p> -->',
    ],
)
def test_layouts(model, page):
    assert text_of(model, f"<!DOCTYPE html><html><head><title>no</title></head><body>{page.format(MAIN)}</body></html>") == WANTED


def test_rows(spark, model):
    rows = [(1, "u", "<article><p>One &amp; two, they say.</p></article>"), (1, "u", "<article><p>One &amp; two, they say.</p></article>"), (2, None, None), (None, "v", ""), (3, "w", " <p> </p>"), (4, "x", "<article>" + "<p>Word after word, and so on.</p>" * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, he.extract(df, model).select("page_id", "url", "text", "n_chars").collect()), key=repr)
    texts = ["One & two, they say."] * 2 + ["", "", "", "\n\n".join(["Word after word, and so on."] * 20_000)]
    assert got == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, texts, strict=True)), key=repr)
    assert he.extract(df.limit(0), model).collect() == []


def test_train_takes_labelled_rows(spark):
    some = labelled_pages(spark, 30)
    assert he.train(some.repartition(3)).weights == he.train(some.coalesce(1)).weights
    with pytest.raises(ValueError, match="no labelled page"):
        he.train(some.limit(0))


def test_query_on_whole_pages(spark, sf):
    """In these pages the main text is what stands in the article."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = he.op11_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])

"""Trained operators by held-out accuracy, and on edge cases."""

import html
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_frames import *  # noqa: F403  (fixtures)
from pyspark.sql import functions as F

from crashlens.llm import html_text, quality_classifier, toxicity
from crashlens.llm.common import utf8_buffer
from crashlens.llm.gru import LENGTH, Network
from crashlens.llm.gru import train as train_network
from crashlens.llm.html_blocks import blocks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def quality_model(corpus):
    return quality_classifier.fit(*corpus)


@pytest.fixture(scope="module")
def network(corpus):
    return toxicity.fit(*corpus)


def test_held_out_quality(corpus, quality_model):
    docs, labels = corpus
    scored = quality_classifier.score(docs, quality_model).join(labels, "doc_id").where(quality_classifier.held_out())
    rows = scored.select("quality", "tail", "expected_grade").collect()
    right = np.mean([(r["tail"] >= 0.5) == (r["quality"] == 1) for r in rows])
    assert len(rows) > 50 and right > 0.9
    assert all(0 <= r["expected_grade"] <= 2 for r in rows)
    assert (np.diff(quality_model.thresholds) > 0).all()


def test_quality_edge_cases(spark, edge_docs, edge_rows, no_docs, quality_model, corpus):
    got = quality_classifier.score(edge_docs, quality_model)
    assert got.count() == len(edge_rows) and got.where("isnan(tail) or tail is null").count() == 0
    empty = {r["tail"] for r in got.where("doc_id in (1, 2, 15)").collect()}
    assert len(empty) == 1  # what the thresholds alone say
    kept = quality_classifier.select(edge_docs, quality_model)
    assert kept.columns == edge_docs.columns
    assert kept.count() == got.where("tail >= 0.5").count()
    assert quality_classifier.score(no_docs, quality_model).count() == 0
    none = quality_classifier.fit(no_docs, corpus[1])
    assert not none.weights.any()
    assert not quality_classifier.fit(corpus[0], corpus[1].where(F.lit(False))).weights.any()
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (3, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality_classifier.fit(corpus[0], odd).thresholds) >= 1


def test_texts_longer_than_the_sample_keep_their_repetition(spark, prose):
    """Good texts of many words and low ones of the same 20 words over and over: the same letters, so it is compression that tells."""
    long = lambda seed, n, low: " ".join([prose(seed, 20)] * (n // 20)) if low else prose(seed, n)
    texts = [(k, long(k, 400 if k < 200 else 2000, k % 2 == 0)) for k in range(400)]
    most = max(len(t) for _, t in texts)
    longer = [(1000 + 2 * k + (not low), long(5000 + k, n, low)) for low in (True, False) for k, n in enumerate((7500, 9000, 15_000, 60_000, 200_000))]
    docs = spark.createDataFrame(texts + longer, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in texts], "doc_id long, quality int, toxic int")
    assert most <= 20_000 < 32_768 <= min(len(t) for _, t in longer)
    model = quality_classifier.fit(docs, labels)
    reached = quality_classifier.repetition(*utf8_buffer(pa.array([t for _, t in longer])))
    assert model.weights[reached].all()
    rows = quality_classifier.score(docs, model).where("doc_id >= 1000").collect()
    assert len(rows) == 10 and all((r["tail"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in rows)
    for k in (1, 7, 30):
        cell = lambda n, k=k: (len(quality_classifier.LENGTHS) << quality_classifier.BITS) + min(15, k) + 16 * n
        assert model.weights[cell(8)] == model.weights[cell(12)]


def test_likelihood_gradient_orders_the_grades():
    draw = np.random.RandomState(0)
    grades = draw.randint(0, 3, 400)
    rows = [(np.array([g * 10 + draw.randint(0, 10), 100 + draw.randint(0, 50)]), np.array([1.0, 1.0])) for g in grades]
    model = quality_classifier.fit_ordinal(rows, grades)
    means = [model.weights[g * 10 : g * 10 + 10].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_held_out_toxicity(corpus, network):
    docs, labels = corpus
    rows = toxicity.score(docs, network).join(labels, "doc_id").where(quality_classifier.held_out()).collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert len(rows) > 50 and right > 0.9
    found = [r["predicted"] for r in rows if r["toxic"]]
    assert np.mean(found) > 0.6


def test_toxicity_edge_cases(edge_docs, edge_rows, no_docs, network, corpus):
    got = toxicity.score(edge_docs, network)
    rows = got.collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 15))
    assert toxicity.score(no_docs, network).count() == 0
    silent = toxicity.fit(corpus[0], corpus[1].where(F.lit(False)))
    assert toxicity.score(edge_docs, silent).where("score > 0.01").count() == 0


def test_every_window_counts(prose, network):
    """Where in a text the words of a toxic one stand does not matter much to its score."""
    data, offsets = utf8_buffer(pa.array([prose(k, 31) for k in range(4)] + [prose(9, 5000)]))
    counts = np.array([0, 5, 31, 32, 33, 100])
    first, text = network.window_rows(counts)
    for k, n in enumerate(counts.tolist()):
        covered = {w for f in first[text == k] - counts[:k].sum() for w in range(f, min(f + LENGTH, n))}
        assert covered == set(range(n))
    together, alone = network.scores(data, offsets), [network.scores(data[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets, offsets[1:], strict=False)]
    assert np.allclose(together, alone, atol=1e-3)


def test_network_gradient():
    draw = np.random.RandomState(1)
    net = Network.start(np.zeros(0, np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.vstack([draw.standard_normal((20, 16)), np.zeros(16)])
    windows = draw.randint(0, 20, (3, 8))
    windows[2, 5:] = 20
    kept = []
    net.logits(x, windows, kept)
    g, d_x = net.gradient(x, windows, np.array([1.0, -2.0, 0.5]), kept)
    loss = lambda: float(net.logits(x, windows) @ np.array([1.0, -2.0, 0.5]))
    for name in ("forth_h", "back_x", "attend", "attend_out", "out", "forth_b"):
        at = tuple(draw.randint(0, n) for n in net.p[name].shape)
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3, name
    x[4, 3] += 1e-3
    up = loss()
    x[4, 3] -= 2e-3
    assert abs((up - loss()) / 2e-3 - d_x[4, 3]) < 1e-3


def test_network_without_both_labels():
    data, offsets = utf8_buffer(pa.array(["some words", "other words"]))
    assert (train_network(data, offsets, np.array([True, True])).scores(data, offsets) > 0).all()
    assert (train_network(data, offsets, np.array([False, False])).scores(data, offsets) < 0).all()


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href=x>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better for all of you.</p></div>
<article><h1>A  long &amp; winding\n title</h1><p>First paragraph, of some length, with <b>bold text and a <a href="y">link</a>.
<p>Second&nbsp;paragraph: it is broken, but <i>it goes on</i> all the same; &lt;tag&gt; and &eacute;&#233;&#xe9;.</p>
<div class="ad">Buy this now, it is the best that you can buy, for little money.</div><p>The end of it, with a last sentence here.</p>
<section class="comments"><p>Great article, I liked it a lot, thank you for writing all of it.</p></section></article>
<aside class="sidebar"><p>Other things that you may like to read, on this site, every day.</p></aside>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; 2024 Site &middot; all rights</footer>"""
TEXT = """A long & winding title
First paragraph, of some length, with bold text and a link.
Second paragraph: it is broken, but it goes on all the same; <tag> and ééé.
The end of it, with a last sentence here."""


@pytest.fixture(scope="module")
def chain(spark):
    return html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_main_text_of_a_page(chain):
    assert html_text.main_text(PAGE, chain) == TEXT


def test_main_text_of_all_pages(spark, chain):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, chain).collect()}
    for row in pages.collect():
        body = row["html"][row["html"].index("<article>") : row["html"].index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|article)>|<br>", body))
        assert got[row["page_id"]] == "\n".join(p for p in parts if p)


def test_layouts_left_out_of_training():
    pages = [(html_text.features(found), labels) for found, labels in html_text.training_pages()]
    n, wrong, total = len(html_text.LAYOUTS), 0, 0
    for k in (0, 3, 7, 11):
        chain = html_text.train([p for j, p in enumerate(pages) if j % n != k])
        for rows, labels in pages[k::n]:
            wrong += sum(a != b for a, b in zip(chain.decode(rows), labels, strict=True))
            total += len(labels)
    assert wrong < 0.05 * total


def test_page_edge_cases(spark, chain):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (3, "u", "just text"), (3, "u", "just text"), (4, "u", "<article><p>" + "word, " * 50_000 + "</article>"), (5, "u", "<script>x"), (6, "u", "<!-- <p>x")]
    pages = spark.createDataFrame([(*r, 1, "b") for r in rows], "page_id long, url string, html string, text int, labels string")
    got = html_text.extract(pages, chain)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    by_id = {r["page_id"]: r for r in got.collect()}
    assert by_id[1]["text"] == by_id[2]["text"] == by_id[5]["text"] == by_id[6]["text"] == ""
    assert by_id[4]["n_chars"] == 6 * 50_000 - 1
    assert html_text.extract(pages.where("page_id = 99"), chain).count() == 0
    assert html_text.fit(pages.where("page_id = 99")).weights.any()


def test_blocks_of_broken_markup():
    found = blocks("<div class='Side-Bars'><p>one<p>two<b>bold</div>three<li>four<li>five &am")
    assert [b.text for b in found] == ["one", "twobold", "three", "four", "five &am"]
    assert found[0].names == {"side", "bar"} and found[0].path == ("div", "p") and found[1].path == ("div", "p")


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a</p><svg-icon name=x></svg-icon><p>rest</p>", ["a", "rest"]),
        ("<p>a</p><title-bar>b</title-bar><template-card><p>c</template-card><p>rest", ["a", "b", "c", "rest"]),
        ("<p>a</p><svg/><p>rest</p>", ["a", "rest"]),
        ('<p>a</p><svg class="i" /><p>rest</p><svg><title/><text>no</text></svg><p>more', ["a", "rest", "more"]),
        ("<p>a</p><svg><path><p>rest</p><svg><text>no</text></svg><p>more", ["a", "rest", "more"]),
        ("<p>a</p><svg><svg><text>no</text></svg><text>no</text></svg><p>rest", ["a", "rest"]),
        ("<p>a</p><template><p>b</p><noscript><p>rest", ["a", "b", "rest"]),
        ("<p>a</p><template><svg><p>no</template></svg><p>rest</p><SVG></SVG ><noscript>no</noscript><p>more", ["a", "rest", "more"]),
        ("<p title=John's>a</p><p>rest</p><p>it's", ["a", "rest", "it's"]),
        ('<p title="it\'s > b" class=\'x"y\'>a</p><p class = "c>d">rest</p>', ["a", "rest"]),
        ('<p>a</p><p title="open>b</p><p>rest</p>', ["a", "b", "rest"]),
        ("<p>a</p><!--><p>rest</p><!-- no --><p>more", ["a", "rest", "more"]),
        ('<script data-x="a>b">no</script foo><p>a</p><style>no</style\n><p>rest<script>"<svg>"</script><p>more', ["a", "rest", "more"]),
    ],
)
def test_no_markup_swallows_the_text_after_it(page, texts):
    assert [b.text for b in blocks(page)] == texts

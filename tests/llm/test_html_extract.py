import re

import numpy as np
import pytest

from tidemark.llm import html_extract as H
from tidemark.llm.html_blocks import blocks

SF = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_proper_and_broken_markup():
    assert texts("<p>a <b>b</b>c<br>d</p><div>e&amp;f &lt;g&gt;\n\t h</div>") == ["a bc d", "e&f <g> h"]
    assert texts("<p>one<p>two<ul><li>x<li>y</ul>z") == ["one", "two", "x", "y", "z"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts('<script>var t="</p>";x("<p>")</script><style>p{}</style><title>t</title>v') == ["v"]
    assert texts("a<!-- b <p> --> c<!-- never ends <p>d") == ["a c"]
    assert texts('<a title="x > y" href=z>link</a></div></p>tail') == ["link", "tail"]
    assert texts("3 < 4 and <p class='a") == ["3 < 4 and"]
    assert texts("cut &am") == ["cut &am"]
    assert texts(None) == texts("") == texts("<p> \n</p>") == []
    assert texts("<textarea>no</textarea><select><option>no</select>yes<button>no</button>") == ["yes"]


def test_text_behind_odd_markup_stays():
    assert texts("<html><head><title>x</title><meta a=b><body><article>one<p>two</article>") == ["one", "two"]
    assert texts("<html><head><title>x</title><article>one</article>") == ["one"]
    assert texts("<head><style>p{}</style> one <p>two") == ["one", "two"]
    assert texts("<head><script>x</script></head><p>one") == ["one"]
    assert texts('<div>a <svg class="i"/>b<svg><title/><path d="M0"/><g/></svg> c</div>d') == ["a", "b", "c", "d"]
    assert texts("<div>a <math><mi/>hidden</math>b</div>") == ["a", "b"]
    assert texts("<div>a <svg><g>hidden</svg>b<div/>c") == ["a", "b", "c"]
    assert texts("<p class=it's>one</p><p>two</p><p class=it's>three</p>") == ["one", "two", "three"]
    assert texts("<p class=it's>one</p><p>two</p>") == ["one", "two"]
    assert texts("<p class='it>one</p><p>two</p>") == ["one", "two"]
    assert texts("<p title=a=\"b>one</p><p>two</p><a title='x > y' href=z>three</a>") == ["one", "two", "three"]


def test_comments_and_templates_end_where_html_says():
    assert texts("a<!-->b<p>c") == ["ab", "c"]
    assert texts("a<!--->b") == texts("a<!--x--!>b") == texts("a<!--x-->b") == ["ab"]
    assert texts("a<!--x->y-->b") == ["ab"]
    assert texts("a<template><template>x</template>y</template>b") == ["a", "b"]
    assert texts("<div>a<template><p>x</div></p>y</template>b</div>c") == ["a", "b", "c"]
    assert texts("a<template>x") == ["a"]


def test_end_tags_without_elements_take_no_time():
    import time

    page = "<div><li>" * 20_000 + "one" + "</section></b></template>" * 20_000 + "two"
    begun = time.perf_counter()
    assert texts(page) == ["one", "two"] and time.perf_counter() - begun < 3


def test_a_long_page_in_slices_and_groups_of_bounded_cells(monkeypatch):
    rng = np.random.default_rng(3)
    model = H.Labeller.fresh(rng)
    long = blocks("".join(f"<p class=x{i % 7}>word{i % 13} {i}." for i in range(500)))
    x, mask = H._stacked([H.features(long)])
    whole = model.scores(x, mask)[:, 0]
    assert np.allclose(model.long_scores(long, 64), whole, atol=1e-4)
    assert np.allclose(model.long_scores(long, 500), whole, atol=1e-4)
    pages = [blocks(f"<p>page {i}<div>b") for i in range(300)] + [long]
    want = model.label(pages)
    seen, stacked = [], H._stacked
    monkeypatch.setattr(H, "CELLS", 256)
    monkeypatch.setattr(H, "_stacked", lambda rows: seen.append(len(rows) * max(map(len, rows))) or stacked(rows))
    got = model.label(pages)
    assert max(seen) <= 256 and all((a == b).all() for a, b in zip(got, want, strict=True))


def test_paths_and_links():
    (b,) = blocks('<div id=mainMenu class="top nav-bar"><p>x <a href=y>four</a></p></div>')
    assert b.path == ("div", ".main", ".menu", ".top", ".nav", ".bar", "p") and b.linked == 4
    deep = blocks("<div>" * 3000 + "x" + "<b>" * 3000 + "y")
    assert [b.text for b in deep] == ["xy"] and len(deep[0].path) <= 13


def test_gradients():
    rng = np.random.default_rng(1)
    model = H.Labeller.fresh(rng)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = rng.normal(size=(5, 3, H.PATH + H.WORDS + H.MEASURES)) * 0.3
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    labels = rng.integers(0, 2, mask.shape).astype(float)

    def loss():
        p = H._sigmoid(model.scores(x, mask))
        return -np.where(mask, labels * np.log(p) + (1 - labels) * np.log(1 - p), 0).sum() / mask.sum()

    found = model.gradients(x, mask, labels)
    for k, w in model.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(n) for n in w.shape)
            kept = w[at]
            w[at] = kept + 1e-4
            high = loss()
            w[at] = kept - 1e-4
            low = loss()
            w[at] = kept
            assert found[k][at] == pytest.approx((high - low) / 2e-4, abs=2e-4), k


@pytest.fixture(scope="module")
def model(spark):
    return H.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def test_pages_of_the_table(spark, model):
    """Their articles are marked; the labeller finds their blocks and no others."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = H.extract(pages, model).collect()
    right = 0
    for r in got:
        inside = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", html[r.page_id], re.S)[1]
        assert r.n_chars == len(r.text)
        right += r.text == "\n".join(b.text for b in blocks(inside))
    assert len(got) == len(html) and right >= 0.98 * len(html)


def test_layouts_it_has_not_seen(spark, model):
    rng = np.random.default_rng(77)
    words = [b.text for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect() for b in blocks(r.html)]
    layout = H._Layout(rng, [t for t in words if len(t) > 40])
    right = wrong = missed = 0
    for _ in range(200):
        page, labels = H._labelled(blocks(layout.page()))
        (found,) = model.label([page]) if page else (labels > 0,)
        right += (found & (labels > 0)).sum()
        wrong += (found & (labels == 0)).sum()
        missed += (~found & (labels > 0)).sum()
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_a_page_by_hand(model):
    page = """<html><body><div class="cookie-banner"><p>We use cookies. Accept all</p></div>
    <div id="menu"><a href="/">Home</a> <a href="/b">Blog</a></div>
    <div class="post-content"><h1>On the ways of rivers</h1>
    <p>Rivers rise in hills, and they fall, after long ways through plains, into seas.</p>
    <div class="advert">Advertisement Buy now and save 50%</div>
    <p>Some of them, however, end in deserts, where the sun takes what the rain gave.</p></div>
    <div class="comments"><h3>2 comments</h3><p>Great article! I liked the part on deserts, thanks.</p></div>
    <div class="footer">&copy; 2024 All rights reserved</div></body></html>"""
    assert model.extract([page])[0].split("\n") == [
        "On the ways of rivers",
        "Rivers rise in hills, and they fall, after long ways through plains, into seas.",
        "Some of them, however, end in deserts, where the sun takes what the rain gave.",
    ]


def test_pages_do_not_influence_each_other(model):
    pages = ["<article><p>" + "word " * n + "</p></article><footer>x</footer>" for n in (3, 40, 900)]
    assert model.extract(pages) == [model.extract([p])[0] for p in pages]


def test_odd_rows(spark, model):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "plain", "x"), (2, "u", "plain", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(pages, model).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id is None] == [""]
    assert [(r.text, r.n_chars) for r in got if r.page_id == 1] == [("", 0)]
    assert H.extract(pages.limit(0), model).count() == 0


def test_learning_from_nothing(spark, monkeypatch):
    monkeypatch.setattr(H, "LAYOUTS", 40)
    empty = spark.createDataFrame([(1, None)], "page_id long, html string")
    assert isinstance(H.learn(empty).extract(["<p>x</p>"])[0], str)

from __future__ import annotations

import time

import numpy as np
import pytest

from dugout.llm import labeller
from dugout.llm.blocks import blocks_of
from dugout.llm.common import table
from dugout.llm.labeller import Labeller, Vectors, main_text, taught


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_blocks():
    assert texts(None) == [] and texts("") == [] and texts("  \n ") == []
    assert texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>a<b>b</b> c<br>d</p>e<div>f") == ["ab c d", "e", "f"]
    assert texts("<p>one<p>two<ul><li>x<li>y</ul>z") == ["one", "two", "x", "y", "z"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><p>x<!-- no <p>y --></p>') == ["x"]
    assert texts("<head><title>t</title></head><body>b<textarea>no</textarea><button>no</button></body>") == ["b"]
    assert texts("<p>a < b and c</p><p>cut <a hre") == ["a < b and c", "cut"]
    assert texts("<p>&eacute;&#233;&#xe9;&nbsp;&bogus;</p>") == ["ééé &bogus;"]
    assert texts('<div title="a > b">x</div>') == ["x"]
    assert texts("<script>never closed <p>x") == []
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]


def test_elements_without_an_end_tag_hide_nothing():
    meta = '<html><head><meta charset="utf-8"><title>t</title><link rel="x" href="y"><style>p{}</style>'
    for start in ("<body>", "<body><article>", "<article>", "<p>", "<span>", '<img src="x">', ""):
        assert texts(f"{meta}\n{start}Whole <b>story</b><p>ends") == ["Whole story", "ends"], start
    assert blocks_of(f"{meta}<body><article>x")[0].path == ("html", "body", "article")
    assert texts("<head><template><p>no</p></template><body>b") == ["b"]
    assert texts("<head><title>t</title></head><p>x</p></head>y") == ["x", "y"]
    assert texts("<body>a<button>Go<p>b<div>c</div>") == ["a", "b", "c"]
    assert texts("<body>a<button><div>Go</div></button>b") == ["a", "b"]
    assert texts("<body><button>Go<button>On</button>b") == ["b"]
    assert texts("<body><button>Go<p>a</p><button><p>On</p></button>b") == ["a", "b"]
    assert texts("<body><select><option>x<option>y<div>b</div><select><option>z</select>c") == ["b", "c"]
    assert texts("<body><svg><g><path d='x'><text>no</text><p>b</p>") == ["b"]
    assert texts("<body><svg><svg></svg><text>no</text></svg>b") == ["b"]
    assert texts("<body><template><button>no<p>no</p></template>b") == ["b"]
    assert texts("<body>" + "<svg>" * 30_000 + "<p>b") == ["b"]


def test_paths_and_links():
    page = '<body><div class="Main-col box" id=top><ul><li><a href="/x">go <b>on</b></a> now</ul></div><nav>n</nav>'
    first, second = blocks_of(page)
    assert first.path == ("body", "div", "main", "col", "box", "top", "ul", "li") and first.linked == 5 and first.text == "go on now"
    assert second.path == ("body", "nav") and taught(second.path) == 0.0
    assert taught(("body", "article", "p")) == 1.0 and taught(("article", "aside")) == 0.0 and taught(("body", "p")) is None


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return labeller.fit(table(spark, sf_dir, "pages"))


def test_given_pages(spark, sf_dir, model):
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("html", main_text(pages, model).alias("text")).collect()
    wanted = [" ".join(b.text for b in blocks_of(r["html"]) if taught(b.path) == 1.0) for r in rows]
    assert [r["text"] for r in rows] == wanted


def test_other_templates(model):
    para = "This is a paragraph of the story, with words and more words. It goes on for a while, and then it ends."
    page = (
        '<html><body><div class="site-header">My site</div><ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul>'
        f'<div class="content"><h1>The title of the story</h1><p>{para}</p><div class="advert">Buy it now</div><p>{para}</p></div>'
        f'<div class="comments"><p>Great story, thanks for it all.</p></div><aside class="sidebar"><p>Popular now</p></aside>'
        '<form class="newsletter"><p>Subscribe to our letter</p></form><div class="cookie-notice">We use cookies</div><footer>&copy; 2020</footer>'
    )
    blocks = blocks_of(page)
    kept = [b.text for b, x in zip(blocks, model.label([blocks], Vectors())[0]) if x > 0.5]
    assert kept == ["The title of the story", para, para]


def long_page(i):
    """A page of one of two sites with names of its own, longer than 12,000 code points and than a run of the fit."""
    rows = "".join(f"<p>Sentence {k} of story {i} says that this and that went on for a while, and then it ended.</p>" for k in range(300))
    links = "".join(f'<li><a href="/{k}">Part {k}</a></li>' for k in range(30))
    return f'<html><body><nav><ul>{links}</ul></nav><article><h1>Story {i}</h1>{rows}</article><footer><p>&copy; {i} all of us</p></footer></body></html>'


def test_long_pages_teach(spark):
    """A table of long pages only: the article comes out, and nothing else."""
    pages = [long_page(i) for i in range(24)]
    frame = spark.createDataFrame([(p,) for p in pages], "html string").repartition(4)
    model = labeller.fit(frame)
    got = {r["html"]: r["t"] for r in frame.select("html", main_text(frame, model).alias("t")).collect()}
    for page in pages:
        assert got[page] == " ".join(b.text for b in blocks_of(page) if "article" in b.path)


def test_runs_of_long_pages():
    rng = np.random.default_rng(0)
    page = blocks_of(long_page(1))
    for _ in range(20):
        runs = labeller.runs_of(page, rng)
        assert all(r.before + len(r.blocks) + r.behind == len(page) and len(r.blocks) == labeller.RUN for r in runs)
        assert all(r.blocks == page[r.before : r.before + labeller.RUN] for r in runs)
        assert {taught(b.path) for r in runs for b in r.blocks} == {0.0, 1.0}
    (whole,) = labeller.runs_of(page[:100], rng)
    assert whole == labeller.Run(page[:100]) and labeller.runs_of(blocks_of("<p>names nothing"), rng) == []


def test_few_pages_that_teach(spark, monkeypatch):
    """Pages without telling names do not use up the sample."""
    monkeypatch.setattr(labeller, "FIT_PAGES", 5)
    silent = [(f"<p>page {i}</p>",) for i in range(400)]
    frame = spark.createDataFrame(silent + [(long_page(i),) for i in range(3)], "html string")
    assert labeller.fit(frame).learned


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([("<p>names nothing</p>",), (None,)], "html string")
    blank = spark.createDataFrame([(None,), ("",)], "html string")
    model = labeller.fit(frame)
    assert not model.learned and not labeller.fit(frame.limit(0)).learned
    assert [r["t"] for r in blank.select(main_text(blank, model).alias("t")).collect()] == ["", ""]
    with pytest.raises(Exception, match="nothing learned"):
        frame.select(main_text(frame, model)).collect()


def test_defined_results(spark, model):
    rows = [(None, 1), ("", 2), ("<p></p>", 3), ("<html><body></body>", 4), ("<article><p>" + "w " * 50_000 + "</article>", 5)]
    frame = spark.createDataFrame(rows, "html string, text int")
    out = [r["t"] for r in frame.coalesce(1).select(main_text(frame, model).alias("t")).collect()]
    assert out[:4] == [""] * 4 and len(out[4].split()) == 50_000
    assert frame.limit(0).select(main_text(frame, model)).count() == 0


def test_gradients():
    """Back-propagation against finite differences of the loss."""
    rng = np.random.default_rng(0)
    given, mask = rng.normal(size=(5, 2, 4 * labeller.STATE)), np.ones((5, 2, 1))
    mask[3:, 1] = 0
    weights, toward = rng.normal(size=(labeller.STATE, 4 * labeller.STATE)) * 0.3, rng.normal(size=(5, 2, labeller.STATE))
    loss = lambda g, w: (labeller.Recurrence.forward(g, w, mask, False)[0][1:].astype(float) * toward).sum()
    states, trail = labeller.Recurrence.forward(given, weights, mask, True)
    to_given, to_weights = labeller.Recurrence.backward(toward, states, trail, weights, mask)
    step = 1e-2
    for at in ((0, 0, 3), (2, 1, 20), (4, 0, 40), (1, 1, 60)):
        more, less = given.copy(), given.copy()
        more[at] += step
        less[at] -= step
        assert abs((loss(more, weights) - loss(less, weights)) / (2 * step) - to_given[at]) < 2e-3
    for at in ((0, 3), (5, 40)):
        more, less = weights.copy(), weights.copy()
        more[at] += step
        less[at] -= step
        assert abs((loss(given, more) - loss(given, less)) / (2 * step) - to_weights[at]) < 5e-3


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_quotes_that_are_no_quotes():
    assert texts("<p data=it's>Hello</p>") == ["Hello"] and texts('<p class="x>Hello') == ["Hello"]
    assert texts("<p title='a > b' data=\"c > d\">Hello</p>") == ["Hello"] and texts("<p a = 'x>y' b>Hello") == ["Hello"]
    assert texts('<a href=x"y>one</a> two') == ["one two"] and texts("<p ' \">Hello</p>") == ["Hello"]
    assert texts("<![CDATA[a > b]]>c") == ["c"] and texts("one<hr>two") == ["one", "two"] and texts("one<hr/>two") == ["one", "two"]


def test_tag_like_text_is_read_in_linear_time():
    start = time.perf_counter()
    for piece in ("<a ", "<!", "<!-", "</script ", "<a x=", "<a x='", '<a x="', "<a x=\"'", "<", "<script>", "<p <", "a<b ", "</", "<a '"):
        for end in ("", ">", "'>", '">', " x"):
            blocks_of(piece * 40_000 + end)
    assert time.perf_counter() - start < 30

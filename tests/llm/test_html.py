"""Main text: the cutter on odd markup, the labeller on pages of other sites than it learnt from."""

from __future__ import annotations

import pytest

from velomart.llm import html as h

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{t}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News</a></li></ul></nav><!-- ad 3 --><div class="ad">{a}</div>
<article><h1>{t}</h1><p><b>{p1}<br><p>{p2}</p><p>{p3}</article><footer>&copy; site &middot; {f}</footer></body></html>"""


def page(k):
    text = lambda s: f"The {s} of page {k} tells about number {k * 7 % 13} and what came of it."
    return PAGE.format(t=text("title"), a=text("advert"), p1=text("first"), p2=text("second &amp; half"), p3=text("third"), f=text("foot"))


@pytest.fixture(scope="module")
def labeller():
    return h.fitted([page(k) for k in range(60)])


def kept(labeller, content):
    blocks = h.Cutter().blocks(content)
    return [b.text for b, p in zip(blocks, labeller.scores([h.Features().rows(blocks)])[0], strict=True) if p >= 0.5]


def test_cutter():
    cut = lambda x: [(b.path, b.text) for b in h.Cutter().blocks(x)]
    assert cut("") == cut("<p> </p><script>x") == []
    assert cut("a &lt;b&gt; \n\t c&nbsp;d") == [((), "a <b> c d")]
    assert cut("<div class='Main nav'>x<p>y<p>z</div>w") == [(("div", ".main", ".nav"), "x"), (("div", ".main", ".nav", "p"), "y"), (("div", ".main", ".nav", "p"), "z"), ((), "w")]
    assert cut("<ul><li>a<li>b</ul></div></p>c") == [(("ul", "li"), "a"), (("ul", "li"), "b"), ((), "c")]
    assert cut('<p title="a > b">t</p><!-- <p>no</p> --><textarea><p>no</textarea>') == [(("p",), "t")]
    assert cut("1 < 2 <3 <<b>x</b>") == [((), "1 < 2 <3 <x")]
    assert cut("<p>open <!-- never closed")[0][1] == "open"


def test_own_pages(labeller):
    whole = kept(labeller, page(99))
    assert [w.split()[1] for w in whole] == ["title", "first", "second", "third"]
    assert whole[2].startswith("The second & half")


def test_other_sites(labeller):
    content = """<body><header class="site-header"><p>Site name</p></header><div id="cookie-banner">We use cookies here.</div>
    <main><h1>Title of it</h1><p>First paragraph of the text.</p><div class="advert">Buy now, it is cheap.</div><p>Second paragraph of it.</p></main>
    <aside class="sidebar"><ul><li><a>Other story</a></li></ul></aside><section id="comments"><div class="comment"><p>Nice text, I liked it.</p></div></section>
    <form><label>Mail</label><button>Send</button></form><footer><p>All rights reserved.</p></footer></body>"""
    for wrapped in (content, content.replace("<main>", "<article>").replace("</main>", "</article>")):
        assert kept(labeller, wrapped) == ["Title of it", "First paragraph of the text.", "Second paragraph of it."]


def test_table(spark, labeller):
    rows = [(1, "u", page(1), "x"), (1, "u", page(1), "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<nav>no</nav>", "x"), (4, "long", "<article>" + "<p>some words of it here.</p>" * 3000 + "</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in h.extract(pages, labeller).collect()}
    assert len(got) == 5 and h.extract(pages, labeller).count() == 6
    assert got[1, "u"].count("\n") == 3
    assert got[2, None] == got[3, "v"] == got[None, "w"] == ""
    assert got[4, "long"].count("\n") == 2999
    assert h.extract(pages.where("false"), labeller).count() == 0
    assert isinstance(h.train(pages.where("false")), h.Labeller)


def test_gradients():
    import numpy as np

    model, rng = h.Labeller.fresh(1), np.random.default_rng(0)
    pages = [rng.normal(size=(n, h.PATH_DIM + h.WORD_DIM + h.COUNT_DIM)).astype(np.float32) for n in (3, 5)]
    labels = [rng.integers(0, 2, len(p)).astype(np.float32) for p in pages]

    def loss():
        p = np.concatenate(model.scores(pages)).astype(np.float64)
        y = np.concatenate(labels)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model._gradients(pages, labels)
    for name, at in (("fx", (3, 5)), ("bx", (9, 40)), ("fh", (2, 17)), ("bh", (4, 60)), ("fc", (20,)), ("o", (7,)), ("oc", (0,))):
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-2
        high = loss()
        model.weights[name][at] = old - 1e-2
        low = loss()
        model.weights[name][at] = old
        assert grads[name][at] == pytest.approx((high - low) / 2e-2, abs=2e-3)


@pytest.mark.parametrize(
    "odd", ['<svg class="i" viewBox="0 > 1"/>', "<svg/>", "<MATH />", "<svg><path/></svg>", "<video-player>", "<svg-icon></svg-icon>", "<title-bar>x</title-bar>", "<audio-x src=a>"]
)
def test_text_goes_on_after(odd):
    texts = [b.text for b in h.Cutter().blocks(f"<article><p>before</p>{odd}<p>after</p></article><p>end</p>")]
    assert [t for t in texts if t != "x"] == ["before", "after", "end"]


def test_raw_elements_hold_no_text():
    for raw in ("<svg a='/'><text>no</text></svg>", "<script/>no</script>", "<video\ncontrols>no</video>", "<title>no</title>"):
        assert [b.text for b in h.Cutter().blocks(f"<p>a</p>{raw}<p>b</p>")] == ["a", "b"]


def test_captions_and_table_footers_are_article_text(labeller):
    content = """<body><nav><ul><li><a>Home</a></li></ul></nav><article><h1>Title of it</h1><p>First paragraph of the text.</p>
    <figure><img src="x"><figcaption>The bridge as it stood in spring.</figcaption></figure><p>Second paragraph of it.</p>
    <table><tr><td>Rides counted by the city</td></tr><tfoot><tr><td>All rides of the year together</td></tr></tfoot></table>
    <p>Third paragraph of it.</p></article><footer><p>All rights reserved.</p></footer></body>"""
    blocks = h.Cutter().blocks(content)
    assert [h.marked(b) for b in blocks] == [False, *[True] * 7, False]
    assert kept(labeller, content) == [b.text for b in blocks[1:-1]]
    assert not h.marked(h.Block(("article", "div", ".footer"), "x")) and not h.marked(h.Block(("article", "footer"), "x"))


def test_a_form_around_the_whole_page(labeller):
    wrapped = page(98).replace("<body>", '<body><form id="aspnet" method="post">').replace("</body>", "</form></body>")
    assert [w.split()[1] for w in kept(labeller, wrapped)] == ["title", "first", "second", "third"]


def test_training_reads_whole_pages(spark):
    """Of a page beyond ``SAMPLE_BLOCKS`` some stretch is learnt, not its beginning."""
    long = "<nav>menu</nav><article>" + "".join(f"<p>word {k} of it.</p>" for k in range(500)) + "</article><footer>end</footer>"
    starts = {int(h.stretch(h.Cutter(), long + " " * k)[0][0].text.split()[1]) for k in range(8) if h.stretch(h.Cutter(), long + " " * k)[0][1]}
    assert len(starts) > 4 and max(starts) > 60
    pages = spark.createDataFrame([(k, "u", long + f"<p>{k}</p>") for k in range(30)], "page_id long, url string, html string")
    assert h.extract(pages, h.train(pages)).first().text.count("\n") > 400

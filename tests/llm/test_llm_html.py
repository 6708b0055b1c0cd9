"""HTML extraction: blocks, the network's gradients, held-out accuracy, the given pages."""

import html
import re

import numpy as np
import pytest

from parselab.llm import html_blocks as net
from parselab.llm import html_train

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body class="with-sidebar">
<nav><ul><li><a href="/a">Home</a><li><a href="/b">More</a></ul></nav><script>var t="</p>";</script>
<div class="ad">Buy &lt;now&gt;</div><!-- <p>not seen</p> --><article><h1>Head &amp;  line</h1>
<p><b>First   part.<br>Second&nbsp;part<p>Third <i>in</i>line, and a &lt;b&gt; sign.</p><ul><li>one<li>two</ul></article>
<footer>&copy; site</footer>"""


def seen(page):
    return [b.text for b in net.blocks(page, net.Paths())]


def test_blocks():
    assert seen(PAGE) == [
        "Home", "More", "Buy <now>", "Head & line", "First part. Second part", "Third inline, and a <b> sign.", "one", "two",
        "© site",
    ]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain", ["plain"]),
        ("a < b > c & d &unknown; &#x41;", ["a < b > c & d &unknown; A"]),
        ("<p>open <script>never closed <p>x", ["open"]),
        ("<!-- never closed <p>x", []),
        ('<p title="a > b">x</p>', ["x"]),
        ('<p title="a>b</p><p>c', ["b", "c"]),
        ("</p></div>x</b>", ["x"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]),
        ("<p>" + "<b>x</b> " * 20000, [" ".join(["x"] * 20000)]),
    ],
)
def test_odd_pages(page, texts):
    assert seen(page) == texts


def test_gradients():
    r = np.random.default_rng(0)
    x = r.standard_normal((5, 3, net.INPUT)) * 0.3
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    mask[1:, 2] = 0
    x *= mask[:, :, None]
    labels = (r.random((5, 3)) > 0.5) * mask
    weights = html_train.start(4, 1, np.float64)
    _, grads = html_train.gradients(x, mask, labels, weights)
    for name, value in weights.items():
        for at in [tuple(r.integers(0, s) for s in value.shape) for _ in range(6)]:
            old, e = value[at], 1e-5
            value[at] = old + e
            up = html_train.gradients(x, mask, labels, weights)[0]
            value[at] = old - e
            down = html_train.gradients(x, mask, labels, weights)[0]
            value[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_padding_changes_nothing():
    paths, buckets = net.Paths(), net._Buckets()
    rows = [net.features(net.blocks(p, paths), paths, buckets) for p in (PAGE, "<p>short</p>")]
    together = net.probabilities(*net.padded(rows), net.trained())
    for k, row in enumerate(rows):
        alone = net.probabilities(*net.padded([row]), net.trained())
        assert np.allclose(together[: len(row), k], alone[:, 0], atol=1e-5)


def test_held_out_accuracy():
    blocks, pages = html_train.accuracy(html_train.generated(200, 99), net.trained())
    assert blocks > 0.985 and pages > 0.85


def test_training_learns():
    data = html_train.generated(150, 5)
    assert html_train.accuracy(data, html_train.train(data, hidden=8, rounds=15))[0] > 0.85


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in net.extract(rows).collect()}
    assert len(found) == rows.count()
    for page in rows.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        parts = [re.sub(r"<[^>]+>", " ", p) for p in re.split(r"</?(?:p|h1)[^>]*>", article)]
        expected = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        r = found[page.page_id]
        assert r.text == expected and r.n_chars == len(expected) and r.url == page.url


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", PAGE, "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = net.extract(df).collect()
    assert sorted(repr((r.page_id, r.url, r.n_chars)) for r in found) == sorted(
        repr((i, u, len(net.article_texts([h or ""], net.trained(), net.Paths())[0]))) for i, u, h, _ in rows
    )
    assert {r.text for r in found if r.page_id in (1, 2)} == {""}
    assert net.extract(df.where("false")).count() == 0

"""Pages in a form, elements that are left open, hand-written pages of other layouts, and very long pages."""

import numpy as np
import pytest

from parselab.llm import html_blocks

TEXT = "The old bridge over the river was closed on Monday, and people in the town had to walk a long way round. "
BODY = "<h1>The bridge is closed</h1>" + "".join(f"<p>{TEXT * 2}It was day {k}.</p>" for k in range(6))
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"


def read(page):
    (text,) = html_blocks.article_texts([page], html_blocks.trained(), html_blocks.Paths())
    return text


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><form method=post action=x.aspx>{NAV}<div id=content><article>{BODY}</article></div></form></body></html>",
        f"<html><body><nav><a href='/'>Home</a><div id=content><article>{BODY}</article></div></body></html>",
        f"<html><body><aside><a href='/'>Home</a><article>{BODY}</article></body></html>",
    ],
)
def test_wraps(page):
    text = read(page)
    assert "day 0" in text and "day 5" in text and "News" not in text


def test_what_else_is_on_the_page_does_not_matter():
    """No verdict by the share of the page's text: an article in a form comes out with and without links after it."""
    article = "<h1>The bridge is closed</h1>" + "".join(f"<p>{TEXT * (k + 1)}</p>" for k in range(3))
    links = "<div class=related><ul>" + "".join(f"<li><a href=/{k}>{TEXT[:60]}{k}</a></li>" for k in range(6)) + "</ul></div>"
    form, plain = (f"<html><body><{t} id=main>{article}</{t}>%s</body></html>" for t in ("form", "div"))
    expected = read(plain % "")
    assert len(expected) > 400
    assert read(form % "") == read(form % links) == read(plain % links) == expected


HAND_WRITTEN = {  # page: article blocks
    "table layout": (
        "<html><body bgcolor=white><table width=700><tr><td colspan=2><b>My Home Page</b></td></tr><tr><td width=100><a href=a.html>Start</a><br>"
        "<a href=b.html>Photos</a><br><a href=c.html>Guestbook</a></td><td><h2>A trip to the lake</h2><p>We left early in the morning, when the fog"
        " was still lying on the fields.<p>By noon the sun had come out, and the children swam until their lips were blue.<p>Nobody wanted to go"
        " home.</td></tr><tr><td colspan=2><font size=1>Copyright 1999 me</font></td></tr></table></body></html>",
        ["A trip to the lake", "We left early in the morning, when the fog was still lying on the fields.",
         "By noon the sun had come out, and the children swam until their lips were blue.", "Nobody wanted to go home."],
    ),
    "no article tag": (
        "<body><div class=topbar><a href=/>Daily Post</a> <a href=/login>Sign in</a></div><div class=story><h1>Mayor opens market</h1><div"
        " class=byline>By Ann Reed</div><p>The new market hall opened its doors on Friday, two years later than planned.</p><p>Stalls were sold"
        " out within a week, the mayor said.</p><h2>What comes next</h2><p>A second hall is to follow in spring.</p></div><div class=sidebar>"
        "<h3>Most read</h3><ul><li><a href=1>Storm warning for the coast</a></li><li><a href=2>Team wins again</a></li></ul></div><div"
        " class=footer>Terms | Privacy | Imprint</div></body>",
        ["Mayor opens market", "The new market hall opened its doors on Friday, two years later than planned.",
         "Stalls were sold out within a week, the mayor said.", "What comes next", "A second hall is to follow in spring."],
    ),
    "how-to with code and list": (
        "<body><header><nav><a href=/>Docs</a><a href=/api>API</a></nav></header><main><h1>Installing the tool</h1><p>Download the archive and"
        " unpack it into a folder of your choice.</p><ol><li>Open a terminal in that folder.</li><li>Run the setup script.</li></ol><pre>"
        "./setup --prefix=/usr/local</pre><p>Afterwards the command is on your path.</p></main><footer><p>Was this page helpful?</p>"
        "<button>Yes</button><button>No</button></footer></body>",
        ["Installing the tool", "Download the archive and unpack it into a folder of your choice.", "Open a terminal in that folder.",
         "Run the setup script.", "./setup --prefix=/usr/local", "Afterwards the command is on your path."],
    ),
    "blog with comments": (
        "<body><div id=header><h1>Garden diary</h1></div><div class=post><h2>Tomatoes at last</h2><p>After weeks of rain the first tomatoes turned"
        " red this morning.</p><blockquote>Patience is the gardener's first tool.</blockquote><p>I picked three and ate them on the spot.</p></div>"
        "<div id=comments><h3>2 comments</h3><div class=comment><b>Lou</b><p>Lovely, mine are still green!</p></div><div class=comment><b>Kim</b>"
        "<p>Which variety is it?</p></div><form><label>Name</label><input><button>Post comment</button></form></div></body>",
        ["Tomatoes at last", "After weeks of rain the first tomatoes turned red this morning.", "Patience is the gardener's first tool.",
         "I picked three and ate them on the spot."],
    ),
    "web form page": (
        "<body><form id=aspnetForm method=post action=default.aspx><div id=menu><ul><li><a href=1>Start</a></li><li><a href=2>Offices</a></li></ul>"
        "</div><div id=content><h1>Opening hours of the archive</h1><p>The reading room is open from Tuesday to Thursday between nine and four.</p>"
        "<p>Please order files a week in advance, as they are kept outside the town.</p></div><div id=footer>City archive, Mill Lane 3</div></form></body>",
        ["Opening hours of the archive", "The reading room is open from Tuesday to Thursday between nine and four.",
         "Please order files a week in advance, as they are kept outside the town."],
    ),
    "notice and advert between": (
        "<body><div class=cookie-banner><p>We use cookies to improve your visit.</p><button>Accept</button></div><article><h1>Rare owl seen in park"
        "</h1><p>A snowy owl has been seen in the city park three days in a row.</p><div class=ad-slot><p>Save 20% on boots today</p></div><p>Experts"
        " think that it was blown south by last week's storm.</p></article><aside><h4>Newsletter</h4><p>Get our best stories by mail.</p></aside></body>",
        ["Rare owl seen in park", "A snowy owl has been seen in the city park three days in a row.",
         "Experts think that it was blown south by last week's storm."],
    ),
}


def test_hand_written_pages():
    """Pages that no generator made; the README gives the share of blocks that are labelled right."""
    right = total = 0
    for page, article in HAND_WRITTEN.values():
        found = [b.text for b in html_blocks.blocks(page, html_blocks.Paths())]
        assert set(article) <= set(found)
        kept = read(page).split("\n")
        right += sum((t in kept) == (t in article) for t in found)
        total += len(found)
    print(f"{right} of {total}")
    assert right >= 0.9 * total


def test_long_page_in_parts():
    page = NAV + BODY + "".join(f"<li><a href=/{k}>link {k}</a>" for k in range(300)) + BODY
    paths, buckets = html_blocks.Paths(), html_blocks._Buckets()
    found = html_blocks.blocks(page, paths)
    whole = html_blocks.probabilities(*html_blocks.padded([html_blocks.features(found, paths, buckets)]), html_blocks.trained())[:, 0]
    for part in (1, 7, 100, 1000):
        assert np.allclose(html_blocks.long_page(found, html_blocks.trained(), paths, buckets, part), whole, atol=1e-5)
    assert html_blocks.article_texts([page, BODY], html_blocks.trained(), html_blocks.Paths(), cells=10) == html_blocks.article_texts(
        [page, BODY], html_blocks.trained(), html_blocks.Paths()
    )


def test_own_ids_on_every_page_stay_bounded(spark, monkeypatch):
    pages = [(k, "u", "".join(f"<div id=x{k}_{n}><p>{TEXT}</p></div>" for n in range(60))) for k in range(30)]
    monkeypatch.setattr(html_blocks, "PATHS_HELD", 100)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert html_blocks.extract(df).count() == 30

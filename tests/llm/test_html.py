"""Main text of pages, against what is known of their making."""

import html
import re

import pytest

from riskframe.llm import html_extraction as hx

BODY = "<p>" + "A long paragraph, with commas, and a stop. " * 5 + "</p>"
TEXT = " ".join(("A long paragraph, with commas, and a stop. " * 5).split())


def page(before="", inside="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}<article><h1>Head</h1>{BODY}{inside}</article>{after}</body></html>"


@pytest.mark.parametrize(
    "before,inside,after",
    [
        ("<nav><ul><li><a href='/x'>Menu</a></ul></nav>", "", "<footer>&copy; us, and them.</footer>"),
        ("<header><p>Site</p></header>", "", "<aside><p>Side, bar, text, here.</p></aside>"),
        ('<div class="cookie-notice"><p>We use cookies, all right?</p></div>', "", '<div id="comments"><p>I disagree, strongly.</p></div>'),
        ("<script>var a = '</p><p>no';</script>", "<style>p{}</style>", "<noscript>no</noscript>"),
        ('<div class="ad">Buy.</div>', '<div class="ad big"><p>Buy this, now.</p></div>', "<form><label>Mail</label><input></form>"),
        ("<!-- <p>hidden, in a comment</p> -->", '<p style="display: none">unseen</p>', '<section class="user comments"><p>First!</p></section>'),
        ("", "<button>Share</button><figure><img alt='a > b'></figure>", "<div role=navigation>Next</div>"),
    ],
)
def test_only_the_article_stays(before, inside, after):
    assert hx.main_text(page(before, inside, after)) == f"Head\n\n{TEXT}"


def test_short_paragraphs_lists_and_headings_stay():
    inside = "<p>Of.</p><h2>Sub &amp; more</h2><ul><li>one<li>two</ul><blockquote>Said&nbsp;so</blockquote><pre>a\n  b</pre>"
    assert hx.main_text(page(inside=inside)) == f"Head\n\n{TEXT}\n\nOf.\n\nSub & more\n\none\n\ntwo\n\nSaid so\n\na b"


def test_pages_without_semantic_elements():
    soup = f'<div id="top"><div class="menu">Home News</div></div><div class="x"><div><h2>Title</h2>{BODY}{BODY}<p>End.</p></div></div><div class="footer">us</div>'
    assert hx.main_text(f"<body>{soup}</body>") == f"Title\n\n{TEXT}\n\n{TEXT}\n\nEnd."


@pytest.mark.parametrize(
    "text,want",
    [
        (None, ""), ("", ""), (" \n ", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>a<p>b", "a\n\nb"), ("<p>a<br>b<b>c</b>d</p>", "a bcd"),
        ("</div></p>x", "x"), ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<article></article><nav>m</nav>", ""), ("<p>cut <a href=", "cut <a href="),
        ("<!-- never closed <p>x", ""), ("<script>never closed <p>x", ""), ("<p>a &amp;lt; &#233; &copy &am</p>", "a &lt; é © &am"),
    ],
)
def test_odd_pages(text, want):
    assert hx.main_text(text) == want


@pytest.mark.parametrize("unit", ["<", "<a ", '<a href="', "<p>", "<div>x", "</p>", "&amp;", "<b>x", "<!--"])
def test_long_odd_pages_take_linear_time(unit):
    hx.main_text(unit * 30_000)


def test_pages_of_the_table(spark, sf_dir):
    from riskframe.llm import queries

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op10_html_extraction"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_rows(spark):
    rows = [(1, "u", page()), (1, "u", page()), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "url AS text", "page_id AS n_chars")
    got = sorted((tuple(r) for r in hx.extract(pages).collect()), key=repr)
    full = f"Head\n\n{TEXT}"
    assert got == sorted([(1, "u", full, len(full))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert hx.extract(pages.limit(0)).count() == 0


SHORT = "<p>One.</p><p>Two.</p>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<article><header><h1>Title</h1></header><div class='body'>{BODY * 12}</div><p>End.</p></article>", ["Title", *[TEXT] * 12, "End."]),
        (f"<article><p>Lede.</p><div>{BODY * 12}</div><div>{BODY}</div></article>", ["Lede.", *[TEXT] * 13]),
        (f"<div class='m'><div>Home</div></div><div class='x'><div>{BODY * 12}</div><div>{BODY}</div></div>", [TEXT] * 13),
        (f"<div class='m'><a>Home</a></div><div class='x'>{SHORT}<blockquote>{BODY * 12}</blockquote>{SHORT}</div>", ["One.", "Two.", *[TEXT] * 12, "One.", "Two."]),
        (f"<div class='x'><h1>Title</h1><div class='y'>{BODY * 12}</div><p>End.</p></div>", ["Title", *[TEXT] * 12, "End."]),
        (f"<h1>Title</h1><div class='y'>{BODY * 12}</div><p>End.</p>", ["Title", *[TEXT] * 12, "End."]),
        (f"<article>{BODY * 12}</article><article>{BODY}</article>", [TEXT] * 13),
    ],
)
def test_nothing_beside_the_longest_part_goes(body, want):
    assert hx.main_text(f"<html><body>{body}</body></html>") == "\n\n".join(want)


@pytest.mark.parametrize(
    "attribute",
    [
        "class='overflow-hidden'", "class='md:hidden'", "aria-hidden='false'", "title='The hidden cost'", "data-x='display:none'", "hidden=until-found",
        "class='no-sidebar'", "class='has-sidebar'", "class='with-comments'", "class='article-header'", "class='share-price'",
        "class='sidebar'", "id=banner", "class='comments'", "aria-hidden=true",
    ],
)
@pytest.mark.parametrize("inner", [f"<article>{BODY * 2}</article>", BODY * 2])
def test_attributes_do_not_set_the_article_aside(attribute, inner):
    assert hx.main_text(f"<body><div {attribute}>{inner}<div class='ads'>Buy.</div></div></body>") == f"{TEXT}\n\n{TEXT}"


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", "aria-hidden='true'", "style='color: red; display:none'", "class='site-footer big'", "id='top_bar-ad'", "class='comments-area'"])
def test_marked_elements_go(attribute):
    assert hx.main_text(f"<body><div class='x'>{BODY * 3}<div {attribute}>{BODY}</div></div></body>") == "\n\n".join([TEXT] * 3)
    talk = f"<section {attribute}>{BODY}<article><p>Teaser.</p></article></section>"
    assert hx.main_text(f"<body><article>{BODY * 3}</article>{talk}</body>") == "\n\n".join([TEXT] * 3)


def test_parts_of_an_article_with_words_of_marks_stay():
    inside = "<div class='article-header'><h2>Sub</h2></div><div class='share-price'><p>Up.</p></div><div title='hidden'><p>Cost.</p></div>"
    assert hx.main_text(page(inside=inside)) == f"Head\n\n{TEXT}\n\nSub\n\nUp.\n\nCost."


SENTENCES = "".join(f"<p>Sentence {i} of the article, which goes on for a while, with commas.</p>" for i in range(6))


@pytest.mark.parametrize("name", ["form", "fieldset", "dialog", "header"])
def test_page_inside_one_wrapper(name):
    """A form around the whole page does not take the article with it; one beside or inside the article goes."""
    article = f"<article><h1>Head</h1>{SENTENCES}</article>"
    want = hx.main_text(article)
    assert want.startswith("Head") and want.count("Sentence") == 6
    assert hx.main_text(f"<body><{name}><nav>Menu one</nav>{article}<button>Send</button></{name}></body>") == want
    assert hx.main_text(f"<body><{name}><p>Your name, please, and more.</p></{name}>{article}</body>") == want
    if name != "header":
        inside = article.replace("</article>", f"<{name}><p>Write to us, if you like.</p></{name}></article>")
        assert hx.main_text(inside) == want
    plain = f"<body><{name}><div>{SENTENCES}</div></{name}></body>"
    assert hx.main_text(plain).count("Sentence") == 6

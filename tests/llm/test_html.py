import re
import time
from html import unescape

import pytest

from rowcloak.llm.html_extract import extract_main_text, main_text

PAGE = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><ul><li><a href=/a>Home, and, more</a></ul></nav></header>
<div class="cookie-notice">We use cookies, accept, please.</div>
<div id="content"><h1>Title &amp; more</h1><div class="post-body"><p>First   paragraph, with <b>bold</b> text, and&nbsp;an <a href=x>link</a>.
<p>Second one.<ul><li>item one<li>item two</ul><blockquote>Quoted, words.</blockquote></div>
<form><input value=1>Search</form></div><aside>Related, links, here</aside>
<div class="sidebar"><p>Popular, things, to, read, now, here.</p></div>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I, disagree, with, everything, here.</p></article></section>
<div class="ad">Buy, now</div><footer>&copy; someone, 2020</footer></body></html>"""


def test_rich_page():
    assert main_text(PAGE) == ("Title & more First paragraph, with bold text, and an link. Second one. item one item two Quoted, words.")


def test_given_pages_give_exactly_the_article(spark):
    rows = extract_main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", article)).split())
        have = r._main_text
        assert " ".join(have.split()) == " ".join(want.split()), r.page_id


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain text, only", "y"), (4, "<p>a</p>" * 2, None), (4, "<p>a</p>" * 2, None),
            (5, "<div>" * 20_000 + "deep, text" + "</b></p>" * 10, ""), (6, "<nav>only, menus</nav>", ""),
            (7, "<p>x &#x41; &lt;b&gt; <!-- c --> y<br>z", ""), (8, "<article>" + "<p>word, word</p>" * 5000 + "</article>", "")]
    df = spark.createDataFrame(rows, "page_id long, html string, _main_text string")
    t = time.time()
    got = {r.page_id: r._main_text for r in extract_main_text(df).collect()}
    assert time.time() - t < 60
    assert got == {1: "", 2: "", 3: "plain text, only", 4: "a a", 5: "deep, text", 6: "", 7: "x A <b> y z", 8: " ".join(["word, word"] * 5000)}
    assert extract_main_text(df.limit(0)).count() == 0


def test_split_sections_without_an_article():
    page = "<body><div id=main><div class=s><p>One, two, three, and four.</p></div><div class=s><p>Five, six, seven.</p></div></div><div class=links>" + "<a href=x>go, there, now</a> " * 9 + "</div></body>"
    assert main_text(page) == "One, two, three, and four. Five, six, seven."


ARTICLE = "<body><nav><a href=/>Home</a></nav><main><article><h1>Title</h1><p>One, two, and three.</p>{}<p>Last, but not least.</p></article></main></body>"
LONG = "The price of a share rose by three percent, as was expected by all who had watched it."


@pytest.mark.parametrize("part, kept", [
    (f'<p class="share-price">{LONG}</p>', LONG), ('<p class="share-price">It rose by 3 %.</p>', "It rose by 3 %."), (f'<p class="reply-all">{LONG}</p>', LONG),
    (f'<p id="ad-2">{LONG}</p>', LONG), ("<aside>A pull quote</aside>", "A pull quote"), ("<p>Tick <label>the box</label> first.</p>", "Tick the box first."),
    (f'<div class="notice-period">{LONG}</div>', LONG), (f'<p>See <span class="related-term">terms</span> here.</p>', "See terms here."),
    (f'<div class="ad">{LONG}</div>', ""), (f'<div id="ad-slot-2">{LONG}</div>', ""), ('<p class="ad">Buy now.</p>', ""), ('<p class="ad"><a href=x>Buy, now, this, or, that, and, never, ask, why, you, did, it, at, all.</a></p>', ""),
    (f'<section class="user-comments"><p>{LONG}</p></section>', ""), (f'<form><p>{LONG}</p></form>', ""), ("<aside><ul><li><a href=x>Related, one</a><li><a href=y>Related, two</a></ul></aside>", ""),
    (f'<div class="cookie-notice">{LONG}</div>', ""), ('<span class="share">Share</span>', ""), (f"<footer>{LONG}</footer>", ""), ("<button>Send</button>", "")])
def test_class_names_raise_doubts_that_texts_defend(part, kept):
    assert main_text(ARTICLE.format(part)) == " ".join(x for x in ("Title One, two, and three.", kept, "Last, but not least.") if x)


POST = '<{0} class="p-{1}"><span class="author">Jo</span> <time>3 May</time><p>I, for one, do not agree with that. Not at all.</p></{0}>'


@pytest.mark.parametrize("part, kept", [
    (f'<ol class="commentlist"><li><p>{LONG}</p></li></ol>', ""), (f'<section id="discussion"><h2>3 Comments</h2><p>{LONG}</p></section>', ""),
    (f'<div class="user-reviews"><p>{LONG}</p></div>', ""), (f"<h2>Comments</h2><ul><li>{LONG}</li><li>{LONG}</li></ul>", ""),
    ("<div>" + POST.format("div", 1) * 3 + "</div>", ""), ("<ol>" + POST.format("li", 2) * 2 + "</ol>", ""),
    (f'<div class="social"><p>The social question: {LONG}</p></div>', f"The social question: {LONG}"), ('<div class="social">Share this</div>', ""),
    (f'<div class="commentary"><p>{LONG}</p></div>', LONG), (f"<section><h2>Discussion</h2><p>{LONG}</p></section>", f"Discussion {LONG}"),
    (POST.format("div", 1), "Jo 3 May I, for one, do not agree with that. Not at all."), (f"<h2>Comments</h2><p>{LONG}</p>", f"Comments {LONG}")])
def test_reader_comments_by_class_heading_and_structure(part, kept):
    page = ARTICLE.replace("One, two, and three.", LONG + " " + LONG).format(part)
    assert main_text(page) == " ".join(x for x in (f"Title {LONG} {LONG}", kept, "Last, but not least.") if x)


def test_comments_behind_an_article():
    page = f'<body><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><section id="discussion"><h2>Comments</h2><div><p>{LONG} {LONG}</p></div></section></body>'
    assert main_text(page) == f"T {LONG} {LONG}"


def test_short_paragraphs_between_kept_siblings():
    many = "a, b, c, d, e, f, g, h, i, j, k, and so on, and on, and on. " * 3
    page = f"<body><h1>T</h1><p>Short one.</p><p>{LONG}</p><p>Short two.</p><div><p>{many}</p></div><p>tail</p></body>"
    assert main_text(page) == f"T Short one. {LONG} Short two. {many.strip()}"


def test_points_against_a_recursive_version():
    from rowcloak.llm.html_extract import TreeBuilder, drop_boilerplate, score_tree

    tree = TreeBuilder()
    tree.feed(PAGE)
    tree.close()
    drop_boilerplate(tree.nodes)
    score_tree(tree)

    def points(node, share):
        return node.given + share * sum(points(x, share) for x in node.items if not isinstance(x, str))

    assert all(abs(n.points - points(n, 0.5)) < 1e-9 and abs(n.total - points(n, 1)) < 1e-9 for n in tree.nodes)
    assert max(n.given for n in tree.nodes) > 2


def test_pages_without_an_article():
    text = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    around = '<div class="site-header">Name, and, more.</div>{}<div class="footer-links"><p>Imprint, terms, and more, of it.</p></div>'
    for page in (f'<div class="page-with-sidebar">{text}</div>', f"<form id=all>{text}</form>", f'<div id="no-sidebar-layout">{text}</div>', f"<table><tr><td>{text}</table>", f"<div>{text}</div>"):
        assert main_text(around.format(page)) == f"Head {LONG} {LONG}", page


def test_nesting_takes_time_in_proportion():
    t = time.time()
    nested = "<div>" * 20_000 + "<p>deep, text</p>" + "</div>" * 20_000
    many = "".join(f"<div>block, {i}" for i in range(20_000))
    bold = "<b>" * 20_000 + "<div>x, y</div>" * 20_000 + "</i>" * 20_000
    assert main_text(nested) == "deep, text" and main_text(many) and main_text(bold)
    assert time.time() - t < 10

import html
import re

import pytest

from gradeloom.llm.html_extract import extract_text, low_nodes, main_text

from .plain import rows_of

PAGES = "page_id bigint, url string, html string, low string, site string, n_chars int"


def article_of(page):
    """The article of a generated page, by its plain structure."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1).replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split())
             for x in re.split(r"</?(?:h1|p)>", body)]
    return "\n".join(x for x in parts if x)


def test_given_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>one<p>two", "one\ntwo"),
    ("<p>a &amp; b&nbsp;&#233;</p>", "a & b é"), ("<p>a<br>b <i>c</i>d</p>", "a b cd"),
    ("<script>var a='<p>x</p>';</script><p>y", "y"), ("<style>p{}</style>z", "z"),
    ("<!-- <p>no</p> --><p>yes", "yes"), ("a < b <p>c", "a < b\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<nav>menu</nav><div class='x'>text</div><footer>f</footer>", "text"),
    ("<header>h</header><article><header><h1>t</h1></header><p>x</p></article>", "t\nx"),
    ("<article><p>x</p><div class='share-bar'>s</div><aside>y</aside></article><p>out", "x"),
    ("<article>x<section id=comments><article>c</article></section></article>", "x"),
    ("<div class='comments'><article>c</article></div><article>x</article>", "x"),
    ("<body class='has-sidebar'><div class='page with-sidebar'><main>x</main></div>", "x"),
    ("<div role='dialog'>d</div><div class='cookie_notice'>c</div><p>x", "x"),
    ("<div class='adBanner'>d</div><div class='loading'>x</div>", "x"),
    ("<form>f<input value='>'></form><p title=\"a>b\">x", "x"),
    ("<p hidden>h</p><p style='display: none'>i</p><p>x", "x"),
    ("<title>t</title><p>x", "x"), ("<div>" * 3000 + "deep", "deep"), ("<p>x</p><script>", "x"),
    ("<p>x</p></div></p></b><i>y", "x\ny"), ("<P CLASS=Ad>n</P><P>x</P>", "x")])
def test_small_pages(page, want):
    assert main_text(page) == want


STORY = "<h1>Head</h1><p>A story of some length.</p>"
TALK = "".join(f"<li class=comment><article class=comment-body><p>{i} I think that this is longer "
               "than the story.</p></article></li>" for i in range(5))


@pytest.mark.parametrize("page", [
    f"<form id=aspnetForm><div class=menu><a href=x>{'menu ' * 30}</a></div>{STORY}</form>",
    f"<form><div class=sidebar>side</div><div class=content>{STORY}</div></form>",
    f"<div class='page with-sidebar'><div id=c>{STORY}</div><div class=sidebar>s</div></div>",
    f"<div class='social-feed'>{STORY}</div><footer>f</footer>",
    f"<div class='social-page'><form id=f>{STORY}</form></div>",
    f"<div class=entry>{STORY}</div><div id=comments><ol>{TALK}</ol></div>",
    f"<div class=entry>{STORY}</div><ol>{TALK}</ol>",
    f"<div class=entry>{STORY}</div><aside><article>teaser</article></aside>",
    f"<div class=sidebar><article>teaser</article></div><div>{STORY}</div>",
    f"<form id=aspnetForm><article>{STORY}</article><p>out</p></form>",
    f"<article class='post comments-open'>{STORY}</article><div id=comments>{TALK}</div>"])
def test_wrappers_stay_and_comments_are_no_story(page):
    assert main_text(page) == "Head\nA story of some length."


def site(n, same="We use no layout names here", copies=0):
    """Pages whose frame has no telling name: only repetition gives it away."""
    rows = []
    for i in range(n):
        k = i if i >= copies else 0
        rows.append((i, "http://a.example/x", f"<div class=x1>{same}</div><div class=x2><p>Story {k} "
                     f"says {k * k} things.</p></div><div class=x3><p>{same} too</p></div>"))
    return rows


def test_repeated_branches_are_cut(spark):
    pages = spark.createDataFrame(site(8), "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert got == {i: f"Story {i} says {i * i} things." for i in range(8)}
    few = spark.createDataFrame(site(4), "page_id bigint, url string, html string")
    assert all("too" in r.text for r in extract_text(few).collect())


def test_copies_of_a_page_are_one_page(spark):
    pages = spark.createDataFrame(site(30, copies=28), "page_id bigint, url string, html string")
    assert all("Story" in r.text for r in extract_text(pages).collect())
    same = [(i, "http://b.example", "<div class=x>only text</div>") for i in range(20)]
    pages = spark.createDataFrame(same, "page_id bigint, url string, html string")
    assert {r.text for r in extract_text(pages).collect()} == {"only text"}


def test_paragraphs_of_an_article_stay(spark):
    rows = [(i, "http://c.example", f"<div class=y>top</div><article><p>Known line.</p><p>{i} new"
             "</p></article>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == {
        i: f"Known line.\n{i} new" for i in range(9)}


def test_awkward_rows(spark):
    rows = [(None, None, "<p>a", "l", "s", 1), (1, "x", None, None, None, None),
            (1, "x", "", "l", "s", 2), (2**62 + 1, "http://h", "<p>b" * 2000, "l", "s", 3)]
    pages = spark.createDataFrame(rows, PAGES)
    assert rows_of(extract_text(pages), "page_id", "url", "text", "n_chars") == sorted(
        [(None, None, "a", 1), (1, "x", "", 0), (1, "x", "", 0),
         (2**62 + 1, "http://h", "\n".join("b" * 2000), 3999)], key=repr)
    assert extract_text(pages.where("page_id = 5")).collect() == []
    assert low_nodes(pages.selectExpr("1L AS site", "html")).collect() == []

import html
import itertools
import os
import re

import numpy as np
import pytest

from stateloom.llm.block_extract import blocks, classify, default_tree, extract_main_text, labelled_rows, main_text

LONG = "The quick brown fox jumps over the lazy dog and then it runs away through the wide green fields until the night falls."


def test_page_with_everything():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) {{ t = "</p>"; }}</script></head><body>
    <header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site to make your visit nice, please accept them all now.</div>
    <aside id="sidebar"><p>{LONG}</p></aside>
    <main><article><h1>A &amp; B</h1><p>{LONG}<p>Second&nbsp;one,  with\n <b>bold</b> <a href="/q">link</a>.<ul><li>First item</li><li>Second</li></ul>
    <div class="ad">Buy now: {LONG}</div><blockquote>Quoted &lt;words&gt;.</blockquote></article>
    <section class="comments"><p>{LONG} I agree with that.</p></section></main>
    <form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2020 {LONG}</footer></body></html>"""
    assert main_text(page) == f"A & B {LONG} Second\xa0one, with bold link. First item Second Quoted <words>."


def test_page_without_article_element():
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><div><h2>About the fox</h2><p>{LONG}</p><p>{LONG} Again.</p></div><div><a href=c>Next</a></div></body>"
    assert main_text(page) == f"About the fox {LONG} {LONG} Again."


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>x", "<!-- only", "<nav>a b c</nav>", "<", "<p", "&"])
def test_nothing(page):
    assert main_text(page) == ""


def test_long_and_broken_markup():
    body = " ".join(f"w{i}" for i in range(60_000))
    assert main_text(f"<article><p>{body}<br>{LONG}</div></span></article") == f"{body} {LONG}"
    assert [b.text for b in blocks("a<b>b</b>c<p>d<td>e<p>f")] == ["abc", "d", "e", "f"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", None, None), (None, None, "", None)], "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in extract_main_text(df).collect()), key=str) == sorted([(1, "u", LONG, len(LONG)), (1, "u", "", 0), (None, None, "", 0)], key=str)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_articles_of_the_tables(spark):
    """The article element's text, block by block, against a plain reading of it."""
    for row in extract_main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)[^>]*>", inside)
        texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts)
        assert row["text"] == " ".join(t for t in texts if t)


@pytest.mark.parametrize(
    "opening,closing",
    [
        ("<main class='content no-sidebar'>", "</main>"),
        ("<article class='post has-comments'>", "</article>"),
        ("<div class='page-legal'>", "</div>"),
        ("<form action=x>", "</form>"),
        ("<form><main class='with-sidebar page-legal'>", "</main></form>"),
    ],
)
def test_articles_in_elements_named_like_boilerplate(opening, closing):
    comments = f"<div class='comments'><p>{LONG} Me too.</p></div>" if "article" in opening else ""
    page = f"<body><nav><a href=a>One</a></nav>{opening}<h1>A title</h1><p>{LONG}</p><p>{LONG} Again.</p><p>{LONG} More.</p>{comments}{closing}<footer>{LONG}</footer></body>"
    assert main_text(page) == f"A title {LONG} {LONG} Again. {LONG} More."


def test_comments_longer_than_the_article():
    comments = "".join(f"<p>{LONG} Comment {i}.</p>" for i in range(30))
    page = f"<main><article><p>{LONG}</p></article><section class='comments'>{comments}</section></main>"
    assert main_text(page) == LONG and main_text(f"<form>{page}</form>") == LONG


def test_letters_that_grow_in_lower_case():
    dots = "\u0130" * 40
    assert main_text(f"<article><p>{dots} {LONG}</p><SCRIPT>x = '<p>'</Script><p>{LONG}</p></article>") == f"{dots} {LONG} {LONG}"


def test_tree_fits_its_labelled_blocks():
    rows = labelled_rows()
    assert np.mean([classify(default_tree(), tuple(r[:-1])) == r[-1] for r in rows]) >= 0.97


@pytest.mark.parametrize("article", [True, False])
def test_tree_decides_by_words_and_links_too(article):
    """Blocks whose elements say the same: what differs is words and links of them and their neighbours."""
    around = (False, article, article)
    text, menu, reference = (80, 0.0, 60, 0.0, 70, 0.0), (2, 1.0, 1, 1.0, 2, 1.0), (14, 1.0, 11, 1.0, 12, 1.0)
    assert classify(default_tree(), (*text, *around, False, False)) == 1
    assert classify(default_tree(), (*menu, *around, False, True)) == 0
    if article:
        assert classify(default_tree(), (*reference, *around, False, True)) == 1


def test_text_of_any_length_stays_in_articles_and_goes_in_boilerplate():
    """Blocks without links of any length among others of any length, where elements tell."""
    counts = (1, 3, 8, 40, 900, 60_000)
    for words, before, after, heading in itertools.product(counts, (0, *counts), (0, *counts), (False, True)):
        flow = (words, 0.0, before, 0.0, after, 0.0)
        assert classify(default_tree(), (*flow, False, True, True, heading, False)) == 1
        for has_article in (False, True):
            assert classify(default_tree(), (*flow, True, False, has_article, heading, False)) == 0
        assert classify(default_tree(), (*flow, False, False, True, heading, False)) == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<main><article><h1>Title</h1><p>Short news of today.</p></article><section class=comments>{'<p>' + LONG + '</p>'}{'<p>' + LONG + '</p>'}</section></main>", "Title Short news of today."),
        (f"<div class='cookie-notice'>{LONG} {LONG}</div><div>{LONG}</div>", LONG),
        (f"<article><p class='social-history'>{LONG}</p><section class='related-work'><h2 id='search-algorithms'>On search</h2><p>{LONG}</p></section></article>", f"{LONG} On search {LONG}"),
        (f"<article><p class=\"x>{LONG}</p><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        ("<article><p>" + LONG + "</p><ol>" + "".join(f"<li><a href=a>A work on the ways of foxes, volume {i}</a></li>" for i in range(3)) + "</ol></article>", LONG + "".join(f" A work on the ways of foxes, volume {i}" for i in range(3))),
        (f"<article><p>{LONG}</p></article><article class='comment'><div class='comment-body'><p>{LONG} No.</p></div></article>", LONG),
        (f"<div class='main-nav'>{LONG}</div><div class='post-content'><p>{LONG}</p></div><div class='site-footer'>{LONG}</div>", LONG),
        (f"<article><p data-id=nav data-class='ad'>{LONG}</p></article>", LONG),
    ],
)
def test_class_words_comments_references(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<head><title>x</title><body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p></header><p>{LONG}</p></article>", f"Title {LONG}"),
        (f"<article><div class='entry-header'><h1>Title</h1><span>By me</span></div><p>{LONG}</article>", f"Title {LONG}"),
        (f"<datalist><option>a<option>b</datalist><article><p>{LONG}</p></article>", LONG),
        (f"<head><meta charset=a><header>Site</header><article><p>{LONG}</p></article>", LONG),
        (f"<article class='post has-sidebar'><p>{LONG}</article>", LONG),
        (f"<main class='content no-comments'><p>{LONG}</main>", LONG),
        (f"<article><ul><li class=share>Share<li>Item text</ul><p class=ad>Buy this<p>{LONG}</article>", f"Item text {LONG}"),
        (f"<article><p>{LONG}</p><p><a href=a>Alone</a></p><p>{LONG}</p><ul><li><a href=a>One two</a><li><a href=b>Three</a></ul></article>", f"{LONG} Alone {LONG}"),
        (f"<svg><text>aa</text></svg><button>Go<article><p>{LONG}</p></article>", LONG),
        (f"<nav/><article><p>{LONG}</p></article>", LONG),
    ],
)
def test_optional_end_tags_and_titles(page, text):
    assert main_text(page) == text

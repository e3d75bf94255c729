"""Extraction keeps all article text: names that say little delete nothing, and the whole table against a second, plain implementation."""

import os
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from prismata.llm import extract

DATA = "/root/testdata/sf0.001"
LONG = "word " * 60


def test_names_that_mark_in_part_delete_nothing():
    assert extract.main_text(f'<article><p class="lead social">{LONG}first</p><p>{LONG}second</p></article>').split("\n\n")[0].endswith("first")
    assert "inside text" in extract.main_text(f'<article><p>{LONG}</p><div class="banner-text">inside text</div><p>{LONG}</p></article>')
    for kept in ('<div class="lead social">', '<h2 class="header">', '<p class="share-price">', '<span class="comment">', '<div class="Widget-Story">', '<ul class="menu-items-of-the-day"><li>'):
        assert "stays" in extract.main_text(f"<article><p>{LONG}</p>{kept}stays</div></h2></p></span></ul><p>{LONG}</p></article>"), kept
    for gone in ('<div class="ad">', '<div class="ad-box">', '<section id="comments">', '<div class="cookie-notice">', '<div role="navigation">', '<p class=advert>', '<div class="relatedList">', '<div class="x" style="display:none">', '<div class="newsletter signup">'):
        assert "goes" not in extract.main_text(f"<article><p>{LONG}</p>{gone}goes</p></div></section><p>{LONG}</p></article>"), gone


def test_a_short_article_hides_no_body():
    body = "text of the page " * 20
    assert body.strip() in extract.main_text(f"<article><p>teaser</p></article><div>{body}</div>")
    assert extract.main_text("<article><p>all there is</p></article><div>else</div>") == "all there is"


def test_link_paragraphs_between_kept_lines_stay():
    page = f'<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><p>{LONG}a</p><p><a href=3>see the study</a></p><p>{LONG}b</p></div><div><a href=4>next page</a></div>'
    assert [b[-9:] for b in extract.main_text(page).split("\n\n")] == ["rd word a", "the study", "rd word b"]


class Plain(HTMLParser):
    """Blocks of the article of a test page."""

    def __init__(self):
        super().__init__()
        self.depth, self.held, self.blocks, self.skip = 0, [], [], 0

    def flush(self):
        text = " ".join("".join(self.held).split())
        if text and self.depth:
            self.blocks.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in extract.BLOCKS:
            self.flush()
        if tag == "br":
            self.held.append(" ")
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "form", "aside") or dict(attrs).get("class") == "ad"

    def handle_endtag(self, tag):
        if tag in extract.BLOCKS:
            self.flush()
        self.depth -= tag == "article"
        self.skip -= bool(self.skip) and tag in ("script", "style", "form", "aside", "div")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.held.append(data)


def blocks_of(page):
    p = Plain()
    p.feed(page)
    p.flush()
    return p.blocks


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_whole_table_against_plain_blocks():
    pages = [x for x in pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist() if x]
    surging = 0
    for page in pages:
        want = blocks_of(page)
        assert extract.main_text(page) == "\n\n".join(want)
        size = [len(b) for b in want]
        surging += any(sum(size[i : i + extract.WINDOW]) > extract.SURGE for i in range(len(size)))
    assert surging > len(pages) // 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_whole_table_without_declared_articles():
    """The same pages with a plain element in place of the article: windows alone find the same text."""
    pages = [x for x in pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist() if x]
    same = 0
    for page in pages:
        want = blocks_of(page)
        undeclared = page.replace("<article", '<div class="story"').replace("</article", "</div")
        same += extract.main_text(undeclared) == "\n\n".join(want)
        assert set(extract.main_text(undeclared).split("\n\n")) <= set(want) or sum(map(len, want)) <= extract.SURGE
    assert same >= 0.95 * len(pages)

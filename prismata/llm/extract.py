"""HTML main-text extraction by the line-block distribution.

Markup is stripped into lines, one for each block element, in page order. What is no article
text by its element (menus, footers, sidebars, forms, code, headers of the page) is left out, and so are blocks
whose class, id or role says nothing but that they are adverts, notices, comments or the like.
A name that says so only in part ("lead social", "banner-text") deletes nothing: its lines just weigh
nothing, as do lines that are all link on a page that declares no article. Other lines weigh the
length of their text. Weights are summed over sliding windows of WINDOW lines: a surge is where the
sum rises over SURGE, the next dive is where it falls to it; every line of a window over
SURGE lies between them.

Surges and dives decide where the text is. If a declared article (article or main) holds a
surge, the text is that of the declared articles, but for those without a surge that hold a link
(teasers). Otherwise the whole page is looked at: the text container is the innermost element that holds SHARE
of all that lies between surges and dives; kept is everything that
stands in it from its first surge to its last dive, and then outwards the short lines of the
same elements (an opening or closing paragraph) and the headings right before. A page
without any surge is a page of a few words: its declared articles are kept, or else all that weighs something.

Null and empty html give an empty text. Character references are decoded, white space
inside a block becomes one space, blocks are joined by an empty line. The time is linear
in the page, broken markup included; nothing is capped. Repeated rows are handled one by
one, other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import string
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
#: Part of the text between surges and dives that the text container holds.
SHARE = 0.6

# Element names, and words of class, id and role that mark what is not article text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template nav footer aside form button select menu dialog svg canvas object audio video head datalist".split())
ARTICLE = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure main nav ol section table tbody td th tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies respond social share sharing related recommended popular popup modal search pagination pager toolbar contentinfo complementary".split()
)
#: Words that mark parts of a page, but inside an article may be its own.
FRAME = frozenset("banner header masthead topbar bottom overlay widget".split())
#: Words that change nothing beside another.
NEUTRAL = frozenset("area bar block box container content inner list main outer section site slot top unit wrap wrapper".split())

TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-zA-Z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _noise(attributes: str, inside: bool) -> int:
    """2: the names of an element say nothing but that it is no article text (or it is hidden); 1: one of them says so in part; 0: none does."""
    marks, found = (NOISE if inside else NOISE | FRAME), 0
    for m in ATTRIBUTE.finditer(attributes):
        told = []
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
            marked = any(w in marks for w in words)
            told.append(2 if marked and all(w in marks or w in NEUTRAL for w in words) else 1 if marked or any(w in FRAME for w in words) else 0)
        if told:
            found = max(found, 2 if min(told) == 2 else min(1, max(told)))
    return 2 if attributes and HIDDEN.search(attributes) else found


def _ascii_lower(text: str) -> str:
    """A-Z lower-cased, every other character in its place."""
    if text.isascii():
        return text.lower()
    for c in string.ascii_uppercase:
        text = text.replace(c, c.lower())
    return text


class Line(NamedTuple):
    text: str
    dropped: bool  # inside an element that is no article text
    article: int  # number of the declared article around it; 0: none
    box: int  # number of the innermost container
    linked: bool  # nothing but link text
    heading: bool
    faint: bool  # inside an element that a name marks in part
    link: bool  # some link text


def lines_of(page: str) -> tuple[list[Line], list[int]]:
    """The lines of the page in order, and the container around each container (a smaller number; 0 is the page)."""
    lines: list[Line] = []
    held: list[str] = []
    low = _ascii_lower(page)
    boxes, around, open_of = [("", 0)], [0], Counter()
    dropped, depth, until_block = "", 0, False  # the element that drops, its open namesakes, and whether any block ends it
    faint, faint_depth, faint_ends = "", 0, False  # the same for the element that only weighs nothing
    articles, article, link, linked, heading = 0, 0, False, 0, False
    last_close: dict[str, int] = {}
    at, end, last_tag = 0, len(page), page.rfind(">")

    def closes(name: str, after: int) -> bool:
        if name not in last_close:
            last_close[name] = low.rfind(f"</{name}")
        return last_close[name] >= after

    def keep(text: str) -> None:
        nonlocal linked
        held.append(text)
        if link:
            linked += len(text)

    def flush() -> None:
        nonlocal link, linked
        if held:
            raw = "".join(held)
            text = " ".join(entities.unescape(raw).split())
            if text:
                lines.append(Line(text, bool(dropped), article if articles else 0, boxes[-1][1], linked >= len(raw.strip()), heading, bool(faint), linked > 0))
        held.clear()
        link, linked = False, 0

    while at < end:
        m = TOKEN.search(page, at) if at <= last_tag or low.find("<!", at) >= 0 else None
        if m is None:
            keep(page[at:])
            break
        if m.start() > at:
            keep(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = _ascii_lower(name), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if name in BLOCKS:
            flush()
            heading = name in HEADINGS and not closing
            if dropped and until_block:
                dropped, until_block = "", False
            if faint and faint_ends:
                faint, faint_ends = "", False
        elif name == "br":
            held.append(" ")
        elif name == "a":
            link = not closing
        if name in CONTAINERS:
            if not closing:
                around.append(boxes[-1][1])
                boxes.append((name, len(around) - 1))
                open_of[name] += 1
            elif open_of[name]:
                while True:
                    inner = boxes.pop()[0]
                    open_of[inner] -= 1
                    if inner == name:
                        break
        if closing:
            if dropped == name:
                depth -= 1
                if depth == 0:
                    flush()
                    dropped = ""
            if faint == name:
                faint_depth -= 1
                if faint_depth == 0:
                    flush()
                    faint = ""
            if name in ARTICLE and not dropped:
                articles = max(0, articles - 1)
            continue
        if name in RAW:
            close = low.find(f"</{name}", at) if closes(name, at) else end
            shut = page.find(">", close)
            at = end if close == end or shut < 0 else shut + 1
            continue
        if dropped:
            depth += name == dropped and name not in VOID
            continue
        if name in VOID:
            continue
        faint_depth += name == faint
        noise = _noise(attributes, articles > 0) if attributes and name not in ("html", "body", *ARTICLE) else 0
        if noise == 2 and not HIDDEN.search(attributes) and (name not in BLOCKS or name in HEADINGS):
            noise = 0  # words of a paragraph, or a heading: never by their names
        if noise == 1 and name in BLOCKS and not faint:
            faint, faint_depth = name, 1
            faint_ends = name == "p" or not closes(name, at)
        if name in DROPPED or (name == "header" and not articles) or noise == 2:
            flush()
            dropped, depth = name, 1
            until_block = name == "p" or not closes(name, at)
            continue
        if name in ARTICLE:
            article += not articles
            articles += 1
    flush()
    return lines, around


def surges(weights: np.ndarray, threshold: int = SURGE, window: int = WINDOW) -> np.ndarray:
    """Whether each line lies between a surge and a dive: in a window whose sum is over the threshold."""
    if not len(weights):
        return np.zeros(0, bool)
    sums = np.convolve(weights, np.ones(window, np.int64))  # of the window that ends at each line, and beyond
    high = (sums > threshold).astype(np.int64)
    return np.convolve(high, np.ones(window, np.int64))[window - 1 : window - 1 + len(weights)] > 0


def _between(lines: list[Line], around: list[int], inside: np.ndarray) -> np.ndarray:
    """Undeclared pages: which lines lie in the text container from its first surge to its last dive, or belong to them. inside: lines of weight between a surge and a dive."""
    box = np.array([x.box for x in lines])
    held = np.zeros(len(around), np.int64)
    np.add.at(held, box[inside], [len(x.text) for x, ok in zip(lines, inside) if ok])
    total = int(held.sum())
    for k in range(len(around) - 1, 0, -1):
        held[around[k]] += held[k]
    main = int(np.flatnonzero(held >= SHARE * total).max())  # these contain each other; the last is the innermost
    within = np.zeros(len(around), bool)
    within[main] = True
    for k in range(main + 1, len(around)):
        within[k] = within[around[k]]
    core = np.flatnonzero(inside & within[box])
    first, last = int(core[0]), int(core[-1])
    own = {main, *box[first : last + 1].tolist()}
    near = lambda k: within[box[k]] and lines[k].box in own and not (lines[k].linked or lines[k].faint)
    while first and near(first - 1):
        first -= 1
    while first and lines[first - 1].heading:
        first -= 1
    while last + 1 < len(lines) and near(last + 1):
        last += 1
    keep = np.zeros(len(lines), bool)
    keep[first : last + 1] = True
    return keep & (within[box] | np.array([x.heading for x in lines]))


def _surging(lines: list[Line], parts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """surges() of each run of lines of one part: no window reaches from one article into another."""
    inside = np.zeros(len(lines), bool)
    for own in np.split(np.arange(len(lines)), np.flatnonzero(np.diff(parts)) + 1):
        inside[own] = surges(weights[own])
    return inside


def main_text(page: str | None) -> str:
    every, around = lines_of(page or "")
    lines = [x for x in every if not x.dropped]
    told = [x for x in lines if x.article]
    if told:
        numbers = np.array([x.article for x in told])
        inside = _surging(told, numbers, np.array([0 if x.faint else len(x.text) for x in told], np.int64))
        if inside.any():
            teasers = {x.article for x in told if x.link} - set(numbers[inside].tolist())
            return "\n\n".join(x.text for x in told if x.article not in teasers)
    size = np.array([0 if x.faint or x.linked else len(x.text) for x in lines], np.int64)
    inside = _surging(lines, np.zeros(len(lines)), size)
    if inside.any():
        lines = [x for x, ok in zip(lines, _between(lines, around, inside & (size > 0))) if ok]
    else:
        lines = told or [x for x, n in zip(lines, size) if n]
    return "\n\n".join(x.text for x in lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_extract(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

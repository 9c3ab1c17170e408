"""Main text of web pages by classifying flat text blocks.

A page is read as a flat sequence of text blocks.  Each block has a word count
and a link density, and so have its neighbours; with what kind of element
holds the block these are the features of a decision tree, which is trained
here on the small labelled table below: whole pages, block by block, each with
and without elements that tell article and boilerplate.  The blocks that it
takes for article text are joined in page order.

Defined cases: a null or empty html gives the empty text; markup without
article text gives the empty text; an element that only its attributes or a
form make boilerplate is none if it holds nearly all words of the page, few of
them links, and no article text stands outside of it, but comments, notices and
adverts always are; class words after no-, has-, with- and the like, class words
that are part of a longer name, and ids of headings say nothing of the element;
character references are decoded; white space is ASCII's (a no-break space is
text); white space inside a block becomes one space; a block of any length is kept whole;
unclosed and stray tags end blocks as closed ones do; elements whose end tag
may be left out end where the next one or their parent does; a tag with a quote
that nothing closes ends at its first ``>``; of a header inside an article the
headings stay; lists of links of a few words are menus, inside an article too,
lists of longer ones are references and stay.
"""

from __future__ import annotations

import html as html_module
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow

# fixed values: element names of HTML by their role for text blocks
RAW = frozenset("script style textarea title iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav header footer aside menu dialog head noscript template svg math object canvas select datalist option button".split())
#: Elements that a head may hold; any other start tag ends it.
IN_HEAD = frozenset("title meta link base script style noscript template".split())
#: Elements whose end tags may be left out: the open ones that the next of them ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that can't hold an article: without an end tag they end where one starts.
HELD_BY_NONE = frozenset("head noscript template svg math canvas select datalist option button p".split())
#: Elements that bound the search for those of ENDS.
BOUNDS = frozenset("ul ol menu dl table select datalist div section article main body header footer nav aside form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are boilerplate as those with BOILER_WORDS are, unless they hold the page's text.
WEAK = frozenset("form fieldset".split())
#: Share of the page's words, largest density of links, and words of article text outside that make a weak element hold it.
WEAK_SHARE, WEAK_DENSITY, WEAK_OUTSIDE = 0.8, 0.3, 10
#: Words of class, id and role attributes.  A token names what no article
#: stands in if its parts between hyphens and underscores are words of these two
#: lines and of PLACES only: elements of the first hold no article at all.
NEVER_WORDS = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login comment comments commentlist respond disqus replies reply reader dialog".split())
BOILER_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer foot sidebar side aside widget widgets form search share sharing social related recommend recommended recommendations tags pagination pager skip toolbar copyright legal complementary contentinfo".split())
PLACES = frozenset("site page main primary secondary global top bottom left right inner outer wrap wrapper container box bar block list item items link links area section panel row column button buttons icon icons title post posts entry article articles story stories message thread form global desktop mobile 1 2 3".split())
#: Words of elements that hold an article's title if they stand inside the article.
TITLE_WORDS = frozenset(("header", "masthead"))
ARTICLE = frozenset(("article", "main"))
ARTICLE_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|article-?body|post-?content)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>|</?[a-zA-Z][^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Class words that tell what an element has or lacks, not what it is.
_TOLD = re.compile(r"(?<!\S)(?:no|not|has|with|without|hide|show)[-_]\S*", re.I)
_PART = re.compile(r"[-_]+")
_NAMES = NEVER_WORDS | BOILER_WORDS | PLACES
_SPACE = re.compile(r"[ \t\r\n\f]+")


class Block:
    __slots__ = ("text", "words", "link_words", "boiler", "article", "heading", "in_list", "weak")

    def __init__(self, text: str, link_words: int, boiler: bool, article: bool, heading: bool, in_list: bool):
        self.text, self.link_words, self.boiler, self.article, self.heading, self.in_list = text, link_words, boiler, article, heading, in_list
        self.weak: tuple[int, ...] = ()
        self.words = len(text.split())

    @property
    def density(self) -> float:
        return min(1.0, self.link_words / self.words) if self.words else 0.0


def _kind(name: str, attributes: str, inside: bool = False) -> str:
    """'b' for an element that holds no article text, 'w' for one that seems so ('wa' if it may hold the article), 'a' for one that holds the article, 'h' for a header."""
    if name in BOILER:
        return "h" if name == "header" else "b"
    if name in WEAK:
        return "w"
    if attributes and "=" in attributes:
        # a heading's id is what links to it name, not what it is
        value = " ".join(x for m in _ATTRIBUTE.finditer(attributes) if name not in HEADINGS or m[1].lower() != "id" for x in m.groups()[1:] if x)
        if value and name not in ("html", "body"):
            tokens = [t for t in (frozenset(_PART.split(t)) - {""} for t in _TOLD.sub(" ", value).lower().split()) if t]
            named = [t for t in tokens if t <= _NAMES and not t <= PLACES]
            if any(t & NEVER_WORDS for t in named):
                return "b"
            article = name in ARTICLE or any(ARTICLE_WORDS.search(" ".join(t)) for t in tokens if t not in named)
            if named:
                if inside and any(t & TITLE_WORDS for t in named):
                    return "h"
                return "wa" if article else "w"
            if article:
                return "a"
    return "a" if name in ARTICLE else ""


@lru_cache(maxsize=64)
def _closing(start: str) -> re.Pattern:
    return re.compile(re.escape(start) + r"(?=[\s/>]|\Z)", re.I | re.A)


def _release(found: list[Block], kinds: list[str]) -> None:
    """Settle which blocks of weak elements are boilerplate."""
    words, links = [0] * len(kinds), [0] * len(kinds)
    total = 0
    chains: dict[int, tuple[int, ...]] = {}
    own: dict[tuple[int, ...], int] = {}  # article words by the weak elements around them
    for b in found:
        if not b.boiler:
            total += b.words
            own[b.weak] = own.get(b.weak, 0) + (b.words if b.article else 0)
            for k, w in enumerate(b.weak):
                chains[w] = b.weak[: k + 1]
                words[w] += b.words
                links[w] += min(b.link_words, b.words)
    outside = {w: sum(own.get(c[:k], 0) for k in range(len(c))) for w, c in chains.items()}
    text = {w for w in chains if words[w] >= WEAK_SHARE * total and links[w] <= WEAK_DENSITY * words[w] and outside[w] < WEAK_OUTSIDE}
    for b in found:
        b.boiler = b.boiler or not text.issuperset(b.weak)
        b.article = b.article or any(kinds[w] == "wa" for w in b.weak if w in text)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    open_elements: list[tuple[str, str]] = []
    weak: list[int] = []
    kinds: list[str] = []
    held: list[str] = []
    links: list[str] = []
    boiler = article = titled = in_link = 0
    heading = in_list = False

    def flush() -> None:
        nonlocal heading
        if held:
            text = _SPACE.sub(" ", html_module.unescape("".join(held))).strip(" ")
            if text:
                linked = len(html_module.unescape(" ".join(links)).split())
                out.append(Block(text, linked, boiler > 0 or titled > 0 and not heading, article > 0, heading, in_list))
                out[-1].weak = tuple(weak)
            held.clear()
            links.clear()

    def close(upto: int) -> None:
        nonlocal boiler, article, titled
        while len(open_elements) > upto:
            _, kind = open_elements.pop()
            boiler -= kind == "b"
            article -= kind == "a"
            titled -= kind == "h"
            if kind in ("w", "wa"):
                weak.pop()

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            text = page[at:]
        else:
            text = page[at : found.start()]
        if text:
            held.append(text)
            if in_link:
                links.append(text)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                held.append(found[0][9:-3])
            continue
        closing = found[1] == "/"
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in INLINE:
            continue
        if name in RAW:
            flush()
            if not closing and not found[3].rstrip().endswith("/"):
                # the content of these has no markup, and without an end tag no end
                end = _closing("</" + name).search(page, at)
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else n
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            for k in range(len(open_elements) - 1, -1, -1):
                if open_elements[k][0] == name:
                    close(k)
                    break
        else:
            if open_elements and open_elements[-1][0] == "head" and name not in IN_HEAD:
                close(len(open_elements) - 1)
            if open_elements and open_elements[-1][0] == "p":
                close(len(open_elements) - 1)
            for k in range(len(open_elements) - 1, -1, -1) if name in ENDS else ():
                if open_elements[k][0] in BOUNDS:
                    break
                if open_elements[k][0] in ENDS[name]:
                    close(k)
                    break
            if name in ARTICLE:
                for k, (other, _) in enumerate(open_elements):
                    if other in HELD_BY_NONE:
                        close(k)
                        break
            kind = _kind(name, found[3], article > 0)
            if kind == "h" and not article:
                kind = "b"
            if found[3].rstrip().endswith("/") and kind == "b":
                continue
            open_elements.append((name, kind))
            boiler += kind == "b"
            article += kind == "a"
            titled += kind == "h"
            if kind in ("w", "wa"):
                weak.append(len(kinds))
                kinds.append(kind)
        heading = not closing and name in HEADINGS
        in_list = not closing and name == "li" or in_list and name not in ("ul", "ol", "p", "div")
    flush()
    if kinds:
        _release(out, kinds)
    return out


FLOW = ("words", "density", "words_before", "density_before", "words_after", "density_after")
FEATURES = (*FLOW, "boiler", "article", "page_has_article", "heading", "in_list")

#: Labelled pages.  A block is its place, words, words in links, and what it is:
#: h a heading, l a list item.  Places: a article text, m a menu inside the
#: article's element, n anything else.
LABELLED = (
    # news with a menu before and a footer behind
    "n1/1l n1/1l n2/2l n1/1l n9/0 a9/0h a60/0 a45/0 a80/0 a35/4 a3/0 a20/0 a6/0 n2/2 n7/1",
    # a blog entry with lists of items and of links inside
    "n3/0 n2/2l n2/2l a5/0h a120/9 a30/0 a4/0h a8/0l a12/0l a3/0l a1/0l a50/0 a6/6 a70/2 m1/1l m2/2l m3/3l m2/2l n1/1l n2/2l n12/1",
    # an entry with references: links as long as titles
    "n1/1l n1/1l n1/1l a7/0h a90/6 a200/0 a2/0h a9/9l a14/14l a11/11l a6/6l a25/25l a40/0 n4/4 n3/3 n5/2",
    # a guide with tags first and sharing behind
    "n6/0 n4/4 a6/0h m1/1l m1/1l m2/2l a25/0 a22/0 a2/0h a18/0 a15/1 a2/0h a300/12 m1/1l m3/3l n30/24 n40/35 n25/22",
    # short paragraphs, talk and verse
    "n2/2l n1/1l n3/3l n1/1l a4/0h a14/0 a16/3 a9/0 a6/0 a2/0 a11/0 a1/0 a7/0 a20/0 n3/3 n1/1 n2/2",
    # a long text without paragraphs, alone
    "a900/20",
    "n1/1l n1/1l n2/2l a5000/0 n1/1l n2/2l n8/0",
    # an overview: links with their teasers, no article
    "n1/1l n2/2l n1/1l n8/8 n12/12 n9/9 n18/12 n10/10 n6/6 n25/22 n60/54 n90/70 n40/34 n1/1 n3/2",
    "n3/3l n6/6l n60/60l n6/6l n1/1l n90/90l n3/0 n6/6 n60/55 n1/1 n4/0 n2/2",
    # a shop's or a portal's front: single words and short lines
    "n1/0 n2/0 n3/0 n2/2 n4/0 n3/0 n1/1 n6/0 n3/3 n5/2 n4/0 n2/0",
    # links of all lengths inside a text
    "n5/5 a8/0h a28/3 a1/1 a35/1 a3/3 a60/2 a12/12 a4/4 a3/3 a45/0 a10/9 a16/3 a30/3 n3/3 n2/2 n9/9",
)


def _page(line: str) -> list[tuple[str, tuple[int, float], bool, bool]]:
    """Place, words and density, heading, in_list of each block of a labelled page."""
    out = []
    for block in line.split():
        words, links = (int(x) for x in block[1:].rstrip("hl").split("/"))
        out.append((block[0], (words, links / words), block.endswith("h"), block.endswith("l")))
    return out


#: Sizes in which labelled pages come whose elements tell what their blocks are.
SIZES = (0.02, 0.1, 0.4, 1, 3, 20, 400, 20_000)


def labelled_rows() -> np.ndarray:
    """The features and labels of all blocks of the labelled pages.

    Each page comes with elements that tell the article and the rest, the
    article only, the rest only, and neither; what is told to be no article may
    stand inside of one, and may be a heading.  Where elements tell what a block
    is, its words may be more or fewer by any factor, unless most are links.
    """
    rows = []
    for line in LABELLED:
        page = _page(line)
        for tells_article, tells_rest, inside in ((True, True, False), (True, True, True), (True, False, False), (False, True, False), (False, False, False)):
            has_article = tells_article and any(place == "a" for place, *_ in page)
            told = [has_article or tells_rest and place == "n" for place, *_ in page]
            # of a size, and beside blocks of another
            for own, other in itertools.product(SIZES, (1, 0.02, 400)) if any(told) else ((1, 1),):
                sized = [[(max(1, round(w * f)), d) if t and d < 0.5 else (w, d) for (_, (w, d), _, _), t in zip(page, told, strict=True)] for f in (own, other)]
                beside = [(0, 0.0), *sized[1], (0, 0.0)]
                for i, (place, _, heading, in_list) in enumerate(page):
                    boiler, article = tells_rest and place == "n", tells_article and place != "n" or inside
                    if told[i] or (own, other) == (1, 1):
                        for h in {heading, heading or told[i] and place == "n"}:
                            rows.append((*sized[0][i], *beside[i], *beside[i + 2], boiler, article, has_article, h, in_list, place == "a"))
    return np.unique(np.array(rows, dtype=float), axis=0)


def fit_tree(rows: np.ndarray, depth: int = 12, least: int = 1):
    """A binary decision tree by Gini impurity: (feature, threshold, low, high) or the label of a leaf."""
    x, y = rows[:, :-1], rows[:, -1]
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0) or len(y) <= least:
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:], strict=True):
            mask = x[:, f] <= low
            p, q = y[mask].mean(), y[~mask].mean()
            impurity = mask.sum() * p * (1 - p) + (~mask).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, (low + high) / 2
    if best is None:
        return int(share >= 0.5)
    _, f, threshold = best
    mask = x[:, f] <= threshold
    return f, threshold, fit_tree(rows[mask], depth - 1, least), fit_tree(rows[~mask], depth - 1, least)


@lru_cache(maxsize=1)
def default_tree():
    return fit_tree(labelled_rows())


def classify(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        f, threshold, low, high = tree
        tree = low if row[f] <= threshold else high
    return tree


def main_text(page: str | None, tree=None) -> str:
    if not page:
        return ""
    tree = default_tree() if tree is None else tree
    found = blocks(page)
    has_article = any(b.article and not b.boiler for b in found)
    kept = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        row = (
            b.words, b.density,
            before.words if before else 0, before.density if before else 0.0,
            after.words if after else 0, after.density if after else 0.0,
            b.boiler, b.article, has_article, b.heading, b.in_list,
        )
        if classify(tree, row):
            kept.append(b.text)
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    return map_arrow(rows, _extract, "page_id long, url string, text string, n_chars long")

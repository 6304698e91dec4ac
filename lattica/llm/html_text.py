"""Main text of web pages: flat text blocks, classified by a small decision tree.

Html is cut into flat blocks at the borders of block elements. A block has its words, the share
of them inside links, and the same of the blocks before and after; further what the elements
around it say (``mark``, see below), and its ``place``: 2 in an article (on a page without one, in
a main element), 0 beside it, 1 on a page without either. A decision tree (Gini splits) is grown from ``EXAMPLES``, a small labelled table of
blocks, and decides each block; scripts, styles, comments of the markup and other unseen
elements never make a block.

``mark`` is 2 where an open element is a menu, footer, sidebar, form or the like by its tag or
role, or where a class or id as a whole names one (``sidebar``, ``cookie-banner``, ``comments``),
also of an article inside another one. It is 1 where such a name is only a part of a longer one
(``legal-note``, ``side-by-side``), can mean other things (``discussion``, ``widget``), or is the id
of a section, which is often made of its title: there words and links of the block and its
neighbours tell. Ids of headings say nothing. Words and links also tell on unmarked blocks of an
article: links of a word or two beside others like them are a menu; a list of longer links, a lone
link or a long block of links is text.

Texts have character references decoded, runs of white space inside a block made one space,
and are trimmed; a page's blocks stand in page order with one newline between them.

Defined results: null or empty html, or a page without article text, gives an empty text and
0 characters. Unclosed and crossing tags are tolerated: an end tag closes the nearest open
element of its name; end tags without one are ignored. A quote belongs to an attribute's value
only right after its equals sign, as browsers read it. Depth and length cost time in proportion.
Repeated rows give repeated results; other columns than page_id, url and html are ignored, null
ids and urls are passed through. An empty table gives an empty table. A comment ends as the HTML
standard says (``-->``, ``--!>``, or at once in ``<!-->``); other declarations and, outside of svg
and math, CDATA sections end at the next ``>``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textblock as tb

#: of EXAMPLES; the tree also sees ``links_beside``, the larger of the two neighbours' shares, and
#: ``longest_link``, the most words of the block and of those neighbours that are links
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "mark", "place", "heading")

#: labelled blocks: FEATURES, then 1 where the block is main text
EXAMPLES = [
    # in an article, with usual neighbours
    (3, 0.0, 40, 0.0, 4, 1.0, 0, 2, 0, 1),
    (2, 0.0, 60, 0.0, 2, 1.0, 0, 2, 1, 1),
    (4, 0.0, 1, 1.0, 3, 1.0, 0, 2, 0, 1),
    (6, 0.0, 30, 0.0, 2, 1.0, 0, 2, 0, 1),
    (7, 0.1, 3, 1.0, 5, 0.9, 0, 2, 1, 1),
    (1, 0.0, 2, 1.0, 2, 1.0, 0, 2, 0, 1),
    (2, 0.0, 0, 0.0, 5, 1.0, 0, 2, 0, 1),
    (40, 0.0, 35, 0.0, 50, 0.0, 0, 2, 0, 1),
    (3, 0.0, 60, 0.0, 40, 0.0, 0, 2, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 2, 0, 1),
    (9, 0.0, 12, 0.0, 80, 0.0, 0, 2, 1, 1),
    (6, 0.0, 1, 1.0, 30, 0.0, 0, 2, 1, 1),
    (80, 0.1, 9, 0.0, 6, 0.0, 0, 2, 0, 1),
    (12, 0.6, 40, 0.0, 40, 0.1, 0, 2, 0, 1),
    (200, 0.0, 0, 0.0, 3, 0.0, 0, 2, 0, 1),
    (25, 0.0, 8, 0.0, 12, 0.2, 0, 2, 0, 1),
    (30, 0.0, 3, 1.0, 2, 1.0, 0, 2, 0, 1),
    (5, 0.2, 2, 1.0, 3, 1.0, 0, 2, 0, 1),
    (4, 0.3, 60, 0.0, 30, 0.0, 0, 2, 0, 1),
    (6, 0.5, 5, 0.4, 7, 0.5, 0, 2, 0, 1),
    # links in an article: alone, or long, they are text
    (2, 1.0, 40, 0.0, 20, 0.0, 0, 2, 0, 1),
    (5, 1.0, 9, 0.0, 40, 0.0, 0, 2, 0, 1),
    (3, 0.9, 12, 0.5, 40, 0.4, 0, 2, 0, 1),
    (4, 1.0, 0, 0.0, 60, 0.0, 0, 2, 1, 1),
    (7, 1.0, 30, 0.2, 0, 0.0, 0, 2, 0, 1),
    (25, 1.0, 30, 0.0, 2, 1.0, 0, 2, 0, 1),
    (18, 0.9, 20, 1.0, 19, 1.0, 0, 2, 0, 1),
    (30, 0.9, 4, 1.0, 25, 0.1, 0, 2, 0, 1),
    (2, 1.0, 1, 0.0, 1, 0.0, 0, 2, 0, 1),
    (1, 1.0, 0, 0.0, 0, 0.0, 0, 2, 0, 1),
    (3, 1.0, 2, 0.0, 60, 0.0, 0, 2, 0, 1),
    (6, 1.0, 60, 0.0, 3, 0.0, 0, 2, 0, 1),
    (5, 0.8, 0, 0.0, 2, 0.3, 0, 2, 0, 1),
    (2, 1.0, 6, 0.2, 1, 0.5, 0, 2, 0, 1),
    (12, 1.0, 3, 1.0, 4, 1.0, 0, 2, 0, 1),
    (15, 1.0, 0, 0.0, 3, 1.0, 0, 2, 0, 1),
    (11, 0.8, 14, 0.9, 2, 0.0, 0, 2, 0, 1),
    # links of a word or two beside others like them are a menu, in an article too
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 2, 0, 0),
    (1, 1.0, 40, 0.0, 2, 1.0, 0, 2, 0, 0),
    (2, 1.0, 2, 1.0, 60, 0.0, 0, 2, 0, 0),
    (1, 1.0, 1, 1.0, 0, 0.0, 0, 2, 0, 0),
    (2, 0.8, 1, 0.9, 2, 1.0, 0, 2, 0, 0),
    (1, 1.0, 2, 0.9, 30, 0.1, 0, 2, 0, 0),
    (2, 0.9, 25, 0.0, 1, 0.9, 0, 2, 0, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 2, 0, 0),
    (1, 1.0, 2, 1.0, 1, 0.0, 0, 2, 0, 0),
    (2, 1.0, 1, 0.0, 2, 1.0, 0, 2, 0, 0),
    (2, 0.9, 80, 0.0, 2, 0.9, 0, 2, 0, 0),
    # a list of longer links, such as titles, is text, a short one among them too
    (5, 1.0, 40, 0.0, 6, 1.0, 0, 2, 0, 1),
    (6, 1.0, 5, 1.0, 4, 1.0, 0, 2, 0, 1),
    (4, 1.0, 6, 1.0, 60, 0.0, 0, 2, 0, 1),
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 2, 0, 1),
    (3, 1.0, 3, 1.0, 0, 0.0, 0, 2, 0, 1),
    (2, 1.0, 6, 1.0, 5, 1.0, 0, 2, 0, 1),
    (2, 1.0, 40, 0.0, 7, 1.0, 0, 2, 0, 1),
    (1, 1.0, 8, 0.9, 30, 0.0, 0, 2, 0, 1),
    (8, 1.0, 6, 1.0, 7, 1.0, 0, 2, 0, 1),
    (4, 1.0, 20, 1.0, 90, 0.0, 0, 2, 0, 1),
    (7, 0.9, 25, 0.0, 5, 0.9, 0, 2, 0, 1),
    # named by an open element, wherever it stands
    (2, 1.0, 2, 1.0, 2, 1.0, 2, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 2, 1, 0, 0),
    (40, 0.0, 1, 1.0, 9, 0.0, 2, 0, 0, 0),
    (60, 0.0, 30, 0.0, 0, 0.0, 2, 0, 0, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 2, 1, 0, 0),
    (4, 0.0, 0, 0.0, 0, 0.0, 2, 1, 0, 0),
    (40, 0.0, 0, 0.0, 0, 0.0, 2, 1, 0, 0),
    (9, 0.0, 0, 0.0, 0, 0.0, 2, 2, 0, 0),
    (15, 0.0, 50, 0.0, 40, 0.0, 2, 2, 0, 0),
    (35, 0.0, 40, 0.0, 12, 0.0, 2, 2, 0, 0),
    (90, 0.0, 10, 0.0, 50, 0.0, 2, 1, 0, 0),
    (4, 0.0, 20, 0.0, 20, 0.0, 2, 1, 1, 0),
    (5, 0.2, 3, 0.0, 2, 1.0, 2, 2, 1, 0),
    (120, 0.0, 90, 0.0, 80, 0.0, 2, 2, 0, 0),
    (9, 0.0, 60, 0.0, 50, 0.0, 2, 2, 0, 0),
    # a name that only holds such a word, in an article: prose stays, short or linked blocks go
    (30, 0.0, 40, 0.0, 50, 0.0, 1, 2, 0, 1),
    (14, 0.1, 60, 0.0, 20, 0.0, 1, 2, 0, 1),
    (55, 0.0, 20, 0.0, 0, 0.0, 1, 2, 0, 1),
    (18, 0.0, 8, 0.0, 35, 0.1, 1, 2, 0, 1),
    (100, 0.2, 60, 0.0, 40, 0.0, 1, 2, 0, 1),
    (12, 0.0, 14, 0.0, 13, 0.0, 1, 2, 0, 1),
    (10, 0.0, 60, 0.0, 30, 0.0, 1, 2, 0, 1),
    (11, 0.1, 9, 0.0, 10, 0.0, 1, 2, 0, 1),
    (3, 0.0, 40, 0.0, 2, 1.0, 1, 2, 0, 0),
    (2, 1.0, 40, 0.0, 30, 0.0, 1, 2, 0, 0),
    (6, 0.0, 50, 0.0, 60, 0.0, 1, 2, 0, 0),
    (4, 0.5, 30, 0.0, 0, 0.0, 1, 2, 1, 0),
    (20, 0.7, 50, 0.0, 40, 0.0, 1, 2, 0, 0),
    (15, 0.9, 2, 1.0, 12, 0.8, 1, 2, 0, 0),
    # beside the article
    (5, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0),
    (6, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0, 0),
    (2, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0),
    (25, 0.0, 20, 0.0, 2, 1.0, 0, 0, 0, 0),
    (7, 0.1, 30, 0.0, 12, 0.2, 0, 0, 1, 0),
    (18, 0.3, 3, 1.0, 20, 0.2, 0, 0, 0, 0),
    (150, 0.0, 90, 0.0, 120, 0.0, 0, 0, 0, 0),
    (30, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0),
    (70, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0),
    (4, 0.5, 60, 0.0, 4, 1.0, 0, 0, 0, 0),
    (8, 0.0, 5, 0.0, 90, 0.0, 0, 0, 1, 0),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0),
    (50, 0.0, 0, 0.0, 30, 0.0, 0, 0, 0, 0),
    (40, 0.0, 50, 0.0, 60, 0.0, 1, 0, 0, 0),
    (100, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0),
    (12, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0),
    (45, 0.1, 4, 0.5, 3, 0.3, 1, 0, 0, 0),
    (3, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 0),
    # pages without an article element: words and links of the block and its neighbours tell
    (40, 0.0, 35, 0.0, 50, 0.0, 0, 1, 0, 1),
    (60, 0.05, 8, 0.0, 4, 0.0, 0, 1, 0, 1),
    (30, 0.2, 60, 0.0, 2, 1.0, 0, 1, 0, 1),
    (7, 0.0, 3, 1.0, 60, 0.0, 0, 1, 1, 1),
    (5, 0.0, 45, 0.0, 50, 0.0, 0, 1, 0, 1),
    (11, 0.0, 60, 0.0, 3, 0.0, 0, 1, 0, 1),
    (50, 0.0, 0, 0.0, 30, 0.0, 0, 1, 0, 1),
    (45, 0.1, 4, 0.5, 3, 0.3, 0, 1, 0, 1),
    (100, 0.0, 2, 1.0, 0, 0.0, 0, 1, 0, 1),
    (18, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (12, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1, 1),
    (60, 0.0, 40, 0.0, 30, 0.0, 1, 1, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (4, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (1, 1.0, 50, 0.0, 0, 0.0, 0, 1, 0, 0),
    (3, 1.0, 0, 0.0, 60, 0.0, 0, 1, 0, 0),
    (1, 1.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0),
    (2, 0.8, 20, 0.0, 30, 0.0, 0, 1, 0, 0),
    (6, 0.0, 2, 1.0, 2, 1.0, 0, 1, 1, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0),
    (20, 0.9, 15, 0.9, 18, 0.9, 0, 1, 0, 0),
    (12, 0.7, 4, 1.0, 3, 0.5, 0, 1, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0),
    (4, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 0),
    (8, 0.4, 50, 0.0, 0, 0.0, 0, 1, 0, 0),
    (1, 0.0, 3, 1.0, 60, 0.0, 0, 1, 0, 0),
    (7, 0.0, 40, 0.0, 12, 0.5, 1, 1, 0, 0),
]

#: elements that are never seen, those that end a block, those without end tag (fixed values)
UNSEEN = {"script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "canvas", "audio", "video", "map", "noframes"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noframes"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKED = {"nav", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: words of class and id names that say what an element is (fixed values)
WORDS = set("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent notice notification alert popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond reply replies disqus skip toolbar pagination pager copyright gdpr form search".split())
#: words that may say so or name a part of the text; beside a word of READERS they mean comments (fixed values)
PERHAPS = set("side discussion discussions widget widgets feedback legal responses".split())
READERS = set("reader readers user users visitor visitors guest".split())
#: what an id of a section says for certain; others may be made of the section's title (fixed values)
CERTAIN = set("nav navbar sidebar footer masthead breadcrumbs comments commentlist comment respond disqus ad ads advert".split())
#: what may stand beside such a word without changing what it says (fixed values)
AROUND = set("site page post article main top bottom left right global primary secondary mobile desktop bar box block section area container wrapper wrap inner outer content list item items group links link buttons button icons icon panel row col slot unit banner bar message text body header footer footer title heading form field input widget tag media network networks posts stories reader user thread tree cookie cookies consent".split())
#: of these, what an article element can be by its own class: replies, adverts, teasers
OF_ARTICLES = set("comment comments reply replies respond ad ads advert advertisement sponsored promo related recommended widget".split())
PARTS = re.compile(r"[a-z]+|[0-9]+")
#: attributes as browsers cut them: a quote opens a value right after an equals sign only
ATTRIBUTES = r"(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)?+)*+"
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z]|\Z)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(" + ATTRIBUTES + r")(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?)?+")
#: what ends an open element of the same kind without its end tag
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "p": ({"p"}, set()), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
WHITE = re.compile(r"\s+")


def _named(value: str, tag: str, in_article: bool, is_id: bool = False) -> int:
    """What a class or id says: 2 where a name as a whole is one of WORDS, 1 where it holds one or one of PERHAPS, else 0."""
    if is_id and tag in HEADINGS:  # ids of headings are made of their text
        return 0
    most = 0
    for name in value.lower().split():
        parts = PARTS.findall(name)
        words = [p for p in parts if p in WORDS and not (in_article and p == "header")]
        perhaps = [p for p in parts if p in PERHAPS]
        if tag in ("article", "main"):
            most = max(most, 2 * (tag == "article" and any(p in OF_ARTICLES for p in words)))
        elif perhaps and any(p in READERS for p in parts):
            most = 2
        elif words:
            whole = all(p in WORDS or p in PERHAPS or p in AROUND or p.isdigit() for p in parts)
            if is_id and tag == "section" and not any(p in CERTAIN for p in words):
                whole = False
            most = max(most, 2 if whole else 1)
        elif perhaps:
            most = max(most, 1)
    return most


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is never seen, and its mark."""
    unseen, mark = tag in UNSEEN, 2 * (tag in MARKED or tag == "header" and not in_article)
    if attributes.strip(" /"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                unseen = True
            elif name == "role" and value.strip().lower() in ROLES:
                mark = 2
            elif name in ("class", "id") and tag not in ("html", "body"):
                mark = max(mark, _named(value, tag, in_article, name == "id"))
    return unseen, mark


class _Open:
    """Open elements, with the places of each tag and of all block elements in the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []  # tag, unseen, mark
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.unseen = self.weak = self.strong = self.headings = 0

    def any(self, *tags: str) -> bool:
        return any(self.places.get(t) for t in tags)

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _change(self, entry: tuple[str, bool, int], by: int) -> None:
        tag, unseen, mark = entry
        self.unseen += by * unseen
        self.weak += by * (mark == 1)
        self.strong += by * (mark == 2)
        self.headings += by * (tag in HEADINGS)

    def push(self, tag: str, unseen: bool, mark: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, unseen, mark))
        self._change(self.stack[-1], 1)

    def close(self, k: int) -> None:
        while len(self.stack) > k:
            entry = self.stack.pop()
            self.places[entry[0]].pop()
            if entry[0] in BLOCKS:
                self.blocks.pop()
            self._change(entry, -1)

    def mark(self) -> int:
        return 2 if self.strong else int(self.weak > 0)


def blocks_of(html: str) -> list[tuple[str, int, int, int, int, bool]]:
    """(text, words, words in links, mark, 2 in an article and 1 in a main element, heading) of each flat block."""
    out: list[tuple[str, int, int, int, int, bool]] = []
    open_ = _Open()
    text: list[str] = []
    links: list[str] = []

    def end() -> None:
        nonlocal text, links
        if text:
            whole = WHITE.sub(" ", unescape("".join(text))).strip()
            if whole:
                out.append((whole, len(whole.split(" ")), len(unescape(" ".join(links)).split()), open_.mark(), 2 if open_.any("article") else int(open_.any("main")), open_.headings > 0))
            text, links = [], []

    def add(part: str) -> None:
        if part and not open_.unseen:
            text.append(part)
            if open_.any("a"):
                links.append(part)

    at, raw = 0, None
    while True:
        if raw:  # nothing but its own end tag ends it
            m = re.compile(rf"</{raw}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            if raw == "textarea":
                add(html[at : m.start() if m else len(html)])
            open_.close(open_.last((raw,)))
            raw = None
            if not m:
                break
            at = m.end()
            continue
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and open_.any("svg", "math"):
                k = html.find("]]>", m.start())
                at = len(html) if k < 0 else k + 3
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            end()
        if m[1]:
            if open_.any(tag):
                open_.close(open_.last((tag,)))
            continue
        if tag in VOID:
            continue
        if tag in CLOSES or tag in BLOCKS:
            ended, stop = CLOSES.get(tag, ({"p"}, set()))
            k = open_.last(ended)
            # what lies between must not hold it: a list around an item, a table around a cell, any block around a paragraph
            border = open_.last(stop) if tag in ("tr", "td", "th") else max(open_.last(stop), next((b for b in reversed(open_.blocks) if open_.stack[b][0] not in ended), -1))
            if k > border:
                open_.close(k if tag not in ("tr", "td", "th") else next(i for i in range(border + 1, len(open_.stack)) if open_.stack[i][0] in ended))
        if m[3].rstrip().endswith("/") and tag not in BLOCKS and tag != "a":
            continue
        unseen, mark = _marks(tag, m[3], open_.any("article"))
        open_.push(tag, unseen or tag == "title", mark)
        if tag in RAW:
            raw = tag
    end()
    return out


def _beside(x: np.ndarray) -> np.ndarray:
    """links_beside and longest_link of rows of FEATURES."""
    words, before, links_before, after, links_after = (x[:, FEATURES.index(f)] for f in ("words", "words_before", "links_before", "words_after", "links_after"))
    longest = np.maximum.reduce([words, np.where(links_before >= 0.5, before, 0), np.where(links_after >= 0.5, after, 0)])
    return np.column_stack([np.maximum(links_before, links_after), longest])


def features(blocks: list[tuple[str, int, int, int, int, bool]]) -> np.ndarray:
    words = np.array([b[1] for b in blocks], float)
    links = np.array([min(b[2], b[1]) / b[1] for b in blocks])
    before, after = np.roll(np.stack([words, links]), 1, axis=1), np.roll(np.stack([words, links]), -1, axis=1)
    before[:, 0] = after[:, -1] = 0
    own = np.array([b[3:] for b in blocks], float)
    inside = max(own[:, 1].max(), 1)  # the article; on a page without one, the main element
    place = np.where(own[:, 1] == inside, 2, 0 if own[:, 1].any() else 1)
    x = np.column_stack([words, links, before.T, after.T, own[:, 0], place, own[:, 2]])
    return np.column_stack([_beside(x), x])


@lru_cache(1)
def tree() -> tuple:
    """(feature, cut, left, right) or a label, grown from the examples until leaves are pure."""
    rows = np.array(EXAMPLES, float)
    table = np.column_stack([_beside(rows), rows])

    def grow(rows: np.ndarray) -> tuple | int:
        y = rows[:, -1]
        if y.min() == y.max() or len(rows) < 2:
            return int(round(y.mean()))
        best = None
        for f in (*range(2, rows.shape[1] - 1), 0, 1):  # of equal splits, those by the block's own features
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = rows[:, f] < cut
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), low)
        if best is None:
            return int(round(y.mean()))
        _, f, cut, low = best
        return f, cut, grow(rows[low]), grow(rows[~low])

    return grow(table)


def classify(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)

    def go(node: tuple | int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            out[rows] = node == 1
            return
        f, cut, left, right = node
        low = x[rows, f] < cut
        go(left, rows[low])
        go(right, rows[~low])

    go(tree(), np.arange(len(x)))
    return out


def main_text(html: str | None) -> str:
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    keep = classify(features(blocks))
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, _, _ in tb.blocks(batch.column("html")):
            part = batch.slice(i, n)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Main text of pages: edges of the markup, and what the tree of words and links decides."""

import os
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from lattica.llm import html_text

PROSE = "a sentence of main text that goes on for a while and says something"


def test_words_and_links_decide_inside_an_article():
    menu = "<ul><li><a href=1>One</a><li><a href=2>Two more</a><li><a href=3>Three</a></ul>"
    assert html_text.main_text(f"<article><p>{PROSE}</p>{menu}<p>{PROSE}</p></article>") == f"{PROSE}\n{PROSE}"
    listed = menu.replace("<a", "<i").replace("</a", "</i")
    assert html_text.main_text(f"<article><p>{PROSE}</p>{listed}<p>{PROSE}</p></article>") == f"{PROSE}\nOne\nTwo more\nThree\n{PROSE}"
    assert html_text.main_text(f"<article><p>{PROSE}</p><p><a href=1>A lone link</a></p><p>{PROSE}</p></article>") == f"{PROSE}\nA lone link\n{PROSE}"
    note = f"<article><p>{PROSE}</p><p class='legal-note'>%s</p></article>"
    assert html_text.main_text(note % PROSE) == f"{PROSE}\n{PROSE}"
    assert html_text.main_text(note % "Terms apply") == PROSE
    assert html_text.main_text(note % f"<a href=1>{PROSE}</a>") == PROSE


def test_attributes_and_comments():
    assert html_text.main_text("<article><p class=it's>Hello</p><p>World</p></article>") == "Hello\nWorld"
    assert html_text.main_text("""<article><p title="a > b" data-x='<p>'>Hello</p><p x = y>World</article>""") == "Hello\nWorld"
    assert html_text.main_text("<article><p>One</p></article><section><article class='comment'><p>Nice post friend</p></article></section>") == "One"
    assert html_text.main_text("<article><p>One</p><article id=comment-7><p>Nice post friend</p></article></article>") == "One"
    assert html_text.main_text("<article class='post sidebar-right'><p>One</p><div class='share-buttons'>Share it</div><div class=notice>We use cookies for the whole of this page and its parts</div></article>") == "One"
    assert html_text.main_text("<article><header><h1>Title</h1></header><p>One</p></article><header>Site</header>") == "Title\nOne"


def test_crossing_deep_and_long_pages():
    assert html_text.main_text("<article><b><p>x</b>y<p>z</article></i>") == "xy\nz"
    assert html_text.main_text("<article><table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table></article>") == "a\nb\nc\nd\ne"
    assert html_text.main_text("<article><ul><li>a<ul><li>b<li>c</ul><li>d</ul></article>") == "a\nb\nc\nd"
    began = time.time()
    assert html_text.main_text("<article>" + "<b>" * 60_000 + "<li>x</li></i>" * 20_000).count("x") == 20_000
    assert html_text.main_text("<div>" * 60_000 + "</p>" * 60_000 + "<a " + "='" * 60_000) == ""
    words = "word " * 400_000
    assert html_text.main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert time.time() - began < 20


def test_tree_is_the_best_split_of_every_node():
    rows = np.array(html_text.EXAMPLES, float)
    table = np.column_stack([html_text._beside(rows), rows])

    def gini(y):
        return len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0

    def check(node, rows):
        if isinstance(node, int):
            assert (rows[:, -1] == node).all()
            return
        f, cut, left, right = node
        low = rows[:, f] < cut
        best = min(gini(rows[rows[:, k] < c, -1]) + gini(rows[rows[:, k] >= c, -1]) for k in range(rows.shape[1] - 1) for c in (np.unique(rows[:, k])[1:] + np.unique(rows[:, k])[:-1]) / 2)
        assert abs(gini(rows[low, -1]) + gini(rows[~low, -1]) - best) < 1e-9
        check(left, rows[low])
        check(right, rows[~low])

    check(html_text.tree(), table)

    def one(row):
        node = html_text.tree()
        while not isinstance(node, int):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node == 1

    rng = random.Random(3)
    x = np.array([[rng.randint(0, 60), rng.random(), rng.randint(0, 60), rng.random(), rng.randint(0, 60), rng.random(), rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 1)] for _ in range(500)])
    x = np.column_stack([html_text._beside(x), x])
    assert html_text.classify(x).tolist() == [one(r) for r in x]
    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(("links_beside", "longest_link", *html_text.FEATURES)[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html_text.tree())
    assert {"words", "links", "links_beside", "longest_link"} <= used


def article(inner, around="%s"):
    return html_text.main_text(around % f"<article><p>{PROSE}</p>{inner}<p>{PROSE}</p></article>").removeprefix(PROSE).removesuffix(PROSE).strip("\n")


def test_comments_of_the_markup_end_as_the_standard_says():
    for markup in ("<!-->", "<!--->", "<!-- x -->", "<!-- x --!>", "<!-- a -- b > -->", "<!----!>", "<!>", "<!x>", "<?php x ?>", "</3>", "</>"):
        assert html_text.main_text(f"<article><p>A</p>{markup}<p>B</p></article>") == "A\nB", markup
    assert html_text.main_text("<article><p>A</p><![CDATA[x><p>B</p></article>") == "A\nB"
    assert html_text.main_text("<article><p>A</p><svg><![CDATA[ x > </svg> ]]></svg><p>B</p></article>") == "A\nB"
    assert html_text.main_text("<article><p>A</p><!-- x <p>B</p></article>") == "A"


def test_names_that_may_mean_a_part_of_the_text():
    for inner in (f"<section class=discussion><p>{PROSE}</p></section>", f"<section id=discussion><p>{PROSE}</p></section>", f"<div class=widget-content><p>{PROSE}</p></div>", f"<section id=search><p>{PROSE}</p></section>"):
        assert article(inner) == PROSE, inner
    assert html_text.main_text(f"<div class='widget-content'><p>{PROSE}</p><p>{PROSE}</p></div>") == f"{PROSE}\n{PROSE}"
    for name in ("search", "cookies", "copyright", "comments", "related"):
        assert article(f"<h2 id={name}>Search</h2>") == "Search"
    for inner in (f"<div class=reader-feedback><p>{PROSE}</p></div>", f"<section id=comments><p>{PROSE}</p></section>", f"<div class='user-discussion'>{PROSE}</div>", f"<div class=comments><p>{PROSE}</p></div>", "<div class=widget>Buy it</div>"):
        assert article(inner) == "", inner


def test_lists_of_links_in_an_article():
    papers = ["Learning to read slowly", "A survey of short texts", "Deep sets"]
    assert article("<ul>" + "".join(f"<li><a href={k}>{p}</a></li>" for k, p in enumerate(papers)) + "</ul>") == "\n".join(papers)
    assert article("<ul>" + "".join(f"<li><a href={k}>{p}</a></li>" for k, p in enumerate(["Home", "News", "About us", "Contact"])) + "</ul>") == ""


def test_pages_without_an_article():
    assert html_text.main_text("Hello world.") == html_text.main_text("<html><body><p>Hello world.</p></body></html>") == "Hello world."
    assert html_text.main_text("<nav><a href=1>Home</a></nav>") == ""
    main = f"<main><p>Sign up for our letter that comes every week with all the news</p><article><p>{PROSE}</p></article><p>Read also our other stories of the week about it</p></main>"
    assert html_text.main_text(main) == PROSE
    assert html_text.main_text(f"<div>Beside it is more of it</div><main><p>{PROSE}</p></main>") == PROSE


class Plain(HTMLParser):
    """A second reader, of the standard library's tokens: blocks of article elements outside of what is named."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.text = [], [], []

    def end_block(self):
        if said := " ".join("".join(self.text).split()):
            self.out.append(said)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.end_block()
        open_ = [t for t, _ in self.stack]
        if tag == "p" and "p" in open_:
            del self.stack[open_.index("p") :]
        if tag not in html_text.VOID:
            named = tag in ("nav", "footer", "script", "style", "aside", "form", "head")
            self.stack.append((tag, named or dict(attrs).get("class") in ("ad", "comments", "sidebar")))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.end_block()
        open_ = [t for t, _ in self.stack]
        if tag in open_:
            del self.stack[len(open_) - 1 - open_[::-1].index(tag) :]

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(named for _, named in self.stack):
            self.text.append(data)


def plain_text(html):
    reader = Plain()
    reader.feed(html)
    reader.close()
    reader.end_block()
    return "\n".join(reader.out)


def made_page(rng):
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gr&ouml;&szlig;e", "x &lt; y", "&copy;", "na\u00efve", "&#x41;"]) for _ in range(n))
    inner = "".join(
        rng.choice(
            [f"<p>{words(30)}", f"<h2 class=title>{words(3)}</h2>", f"<p><b>{words(9)}</b><br>{words(12)}</p>", f"<!-- {words(3)} --><p>{words(20)}</p>", f"<div class=ad>{words(12)}</div>", f"<script>if (a < b) '</p>'</script>", f"<blockquote><p>{words(15)}</p></blockquote>", f"<aside>{words(9)}</aside>", f"<p>{words(8)} <a href='/x'>{words(4)}</a> {words(7)}</p>"]
        )
        for _ in range(rng.randrange(1, 12))
    )
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body><nav><ul><li><a href=/>{words(1)}</a></li></ul></nav><div class=\"ad\">{words(9)}</div><article><h1>{words(5)}</h1>{inner}</article><footer>{words(8)}</footer></body></html>"


def test_a_second_reader_says_the_same():
    rng = random.Random(12)
    for _ in range(300):
        page = made_page(rng)
        assert html_text.main_text(page) == plain_text(page), page


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_a_second_reader_says_the_same_of_the_tables():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        assert html_text.main_text(page) == plain_text(page)


def test_odd_pages(spark):
    rows = [(1, None, None, 5), (None, "u", "", 5), (2, "u", "<article>x</article>", 5), (2, "u", "<article>x</article>", 5), (3, "u", " ", 5), (4, "u", "<article><p>" + "y " * 200_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()), key=repr)
    want = [(1, "", 0), (None, "", 0), (2, "x", 1), (2, "x", 1), (3, "", 0), (4, ("y " * 200_000).strip(), 399_999)]
    assert got == sorted(want, key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0

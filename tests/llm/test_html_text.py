"""Main text: minimum cuts against enumeration, and pages of many shapes."""

import html
import itertools
import random
import re

import numpy as np

from millrace.llm import html_text as H


def cost(side, prefer, edges):
    """What a labelling cuts: terminal capacities of the wrong side and smoothness edges between sides."""
    return sum(max(p, 0) if not s else max(-p, 0) for s, p in zip(side, prefer, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])


def test_min_cut_is_least():
    draw = random.Random(1)
    for _ in range(300):
        n = draw.randint(1, 7)
        prefer = [draw.choice([-2, -1, -0.5, 0, 0.3, 1, 2]) * draw.random() for _ in range(n)]
        edges = [(i, j, draw.random()) for i, j in itertools.combinations(range(n), 2) if draw.random() < 0.5]
        least = min(cost(s, prefer, edges) for s in itertools.product([False, True], repeat=n))
        assert abs(cost(H.min_cut(prefer, edges), prefer, edges) - least) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, do accept them all now please.</div><article><h1>Title</h1><p>First paragraph, long enough to be one. A &amp; B&nbsp;C &lt;x&gt;</p>
<p>Short.</p><form><p>Your name</p><input></form><p>Last <b>bold</b>ly<br>said.</p></article>
<aside>Another long article that you may want to read as well, honestly.</aside><section id="comments"><article><p>What a great article, I enjoyed it a lot. Thanks!</p></article></section>
<div class="ad">Buy now, this is cheap and good. Really cheap.</div><footer>&copy; all rights reserved.</footer></body></html>"""
TEXT = "Title First paragraph, long enough to be one. A & B C <x> Short. Last boldly said."


def test_article():
    assert H.main_text(PAGE) == TEXT
    assert H.main_text(PAGE.replace("<article><h1>", '<div id="content"><h1>', 1).replace("</article>\n<aside>", "</div>\n<aside>")) == TEXT


def test_class_words_of_wrappers():
    story = "<p>One long paragraph of the story, with words enough to be one.</p><p>And another of them, which ends the story here.</p>"
    article, text = f"<article>{story}</article>", "One long paragraph of the story, with words enough to be one. And another of them, which ends the story here."
    rest = '<nav><a href="/">Home</a></nav>', '<div class="ad">Buy now, this is cheap.</div><div class="sidebar"><article><p>Another story, read it as well.</p></article></div>'
    for tag in ('div class="layout has-sidebar"', 'div id="search-page"', 'div class="post no-comments"', 'form id="aspnetForm"', 'div class="hasSidebar with-ads"', 'div class="banner share"'):
        for inner in (article, f"<div>{story}</div>"):
            page = f"<html><body>{rest[0]}<{tag}>{inner}</{tag.split()[0]}>{rest[1]}</body></html>"
            assert H.main_text(page) == text, page
    assert H.main_text(f'<form><nav>Home</nav><div class="sidebar-layout">{article}</div><footer>(c)</footer></form>') == text
    assert H.main_text(f'<div class="no-comments"><script>{story}</script><div hidden>{article}</div></div>') == ""


def learned():
    """Weights of pages as a site has them."""
    draw = random.Random(5)
    words = lambda n: " ".join(draw.choice("the house stands on a hill and looks over many fields".split()) for _ in range(n))
    pages = []
    for _ in range(60):
        body = "".join(f"<p>{words(draw.randint(4, 60))}.</p>" for _ in range(draw.randint(2, 8)))
        links = "".join(f'<li><a href="/x">{words(2)}</a></li>' for _ in range(6))
        pages.append(f'<body><nav><ul>{links}</ul></nav><div>{words(3)}</div><article><h1>{words(5)}</h1>{body}</article><div class="ad">{words(12)}.</div><footer>{words(4)}</footer></body>')
    return H.learned([(*r, 1.0) for p in pages for r in H.labelled(p)])


def test_learned_weights():
    w = dict(zip(H.PRIOR, learned(), strict=True))
    assert w["article"] > 0 and w["length"] > 0 > w["links"] and w["marked"] < -3 and w["chrome"] < -3 and all(map(np.isfinite, w.values()))
    assert H.learned([]) == tuple(H.PRIOR.values())
    weights = tuple(w.values())
    assert H.main_text(PAGE, weights) == TEXT
    assert H.main_text(PAGE.replace("<article><h1>", "<div><h1>", 1).replace("</article>\n<aside>", "</div>\n<aside>"), weights) == TEXT


def test_the_cut_decides():
    """Without an article element: short lines alone look like boilerplate, and between the paragraphs of a text they are content."""
    long = "<p>One long paragraph of the story, with words enough to be one, and some more of them to go on.</p>"
    page = f'<body><div><a href="/">Home</a></div><div>{long}<p>Well then</p>{long}<p>Said he</p>{long}</div><div><span>Imprint</span></div></body>'
    for weights in (tuple(H.PRIOR.values()), learned()):
        found = H.blocks_of(page)
        alone = [H.preference(b, weights) > 0 for b in found]
        assert [b.text for b, x in zip(found, alone, strict=True) if not x] == ["Home", "Well then", "Said he", "Imprint"]
        got = H.main_text(page, weights)
        assert "Well then" in got and "Said he" in got and "Home" not in got and "Imprint" not in got


def test_what_is_no_article_has_a_finite_cost():
    """A section of class legal, tags or search that is most of the page is its text; beside an article it is not."""
    body = "<p>The legal section of the article is long, and it goes on for a while so that it is a text.</p>" * 3
    for word in ("legal", "tags", "search", "discussion"):
        assert H.main_text(f'<body><nav>Home</nav><div class="{word}">{body}</div></body>').count("legal section") == 3
        assert H.main_text(f'<body><article><p>Here is the article, and it is this sentence.</p></article><div class="{word}">{body}</div></body>') == "Here is the article, and it is this sentence."


def test_long_pages_of_undecided_blocks():
    draw = random.Random(1)
    prefer = [draw.uniform(-2, 2) for _ in range(30_000)]
    edges = [(i, i + 1, 1.0) for i in range(len(prefer) - 1)]
    side = H.min_cut(prefer, edges)
    paths = [0.0, 0.0]  # the least cost of a chain, by the side of its last block
    for i, p in enumerate(prefer):
        own = max(p, 0), max(-p, 0)
        paths = [own[x] + min(paths[x], paths[1 - x] + (1.0 if i else 0.0)) for x in (0, 1)]
    assert abs(cost(side, prefer, edges) - min(paths)) < 1e-6


def test_broken_markup():
    assert H.main_text("<article><p>One two three four five, six.<p>Seven eight<b>nine<p>Ten &am") == "One two three four five, six. Seven eightnine Ten &am"
    assert H.main_text("<article><p>Text here is good.</p><script>if (a<b) '</article>'") == "Text here is good."
    assert H.main_text('<article><p title="a>b">Quoted, with enough words to count.</p></article') == "Quoted, with enough words to count."
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == ""
    assert H.main_text("<article><!-- <p>no</p> --><p>Yes, this is the text.</p></article>") == "Yes, this is the text."


def test_nothing_is_capped():
    words = " ".join(f"w{i}." for i in range(60_000))
    assert H.main_text(f"<article><p>{words}</p></article>") == words
    many = "".join(f"<p>Paragraph number {i} of the page.</p>" for i in range(3000))
    assert H.main_text(f"<main>{many}</main>").count("Paragraph") == 3000


def test_given_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r for r in H.op6_html_text(spark, sf).collect()}
    for r in rows:
        body = r["html"].split("<article>", 1)[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_frames(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "y"), (1, "u", "<article><p>Some text.</p></article>", "z")] * 2, "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in H.extract(pages).collect()) == ["", "", "", "", "Some text.", "Some text."]
    assert H.extract(pages.where("false")).count() == 0

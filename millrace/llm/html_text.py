"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text with their open elements. A linear classifier over the block's place, its
class and id words, length, punctuation and share of link text gives a cost for calling it content and one for calling
it boilerplate: the capacities of its edges to the two terminals. Neighbouring blocks, and consecutive blocks
under one parent, are joined by smoothness edges. The minimum cut separates content from boilerplate; it is
found by max-flow over the blocks that their own costs don't decide (a block whose preference outweighs all its
smoothness edges is on its own side in every minimum cut, so it is taken out first and its edges become costs).

The classifier is a logistic regression, learned from at most `sample_pages` pages with an article element: their blocks are
labelled content inside it and boilerplate outside or in what no article's text is (menus, asides, forms, class words of comments
and so on). Every block counts twice, with and without the article as a feature, so the weights also serve pages that have none.
`PRIOR` is where a weight stays of which the sample tells nothing; the sample counts as much as `evidence` blocks.
What is no text (scripts, styles, what is hidden) has an infinite cost; all else that speaks against a block has a finite one.
Form and class words only mark what is in them. A mark ends at an article in it, but for those of comments,
advertisements and the like; none counts that holds most of the page's text, with no article outside. Words after has-, no- and
the like tell of another element.

Defined results: null and empty pages have the empty text; repeated rows repeated results; broken markup is read as browsers
read it, as far as open elements go; nothing is dropped for length.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass, field
from operator import mul

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, smallest, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)[^>]*>?|<[!?/][^>]*>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Their content is no markup and no text of the page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text goes on in the block around them.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What holds no text of the page, and what no article's text, by element and by word of class, id or role.
NEVER = set("head button select option script style noscript template object svg math canvas iframe audio video".split())
CHROME = set("nav footer aside dialog menu".split())
NEVER_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer footnav sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert popup modal overlay comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe signup login search "
    "pagination pager widget toolbar masthead copyright legal disclaimer complementary contentinfo tags".split()
)
#: Articles inside these are none of the page's.
STICKY_WORDS = set("comment comments commentlist disqus reply replies respond discussion ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion related recommended sidebar aside widget".split())
#: A class of a layout that has or lacks a part is not the part.
STATE = re.compile(r"(?:has|no|with|without|hide|not|non)(?:[-_]|(?=[A-Z]))")
HEADER_WORDS = {"header", "topbar", "masthead"}
CONTENT_WORDS = set("article content post entry story main articlebody text body".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Inside these an open element of the kind is another's.
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "html", "blockquote", "td", "th", "aside", "nav", "footer", "header", "form"}

#: Weights before anything is learned: of the constant, 80 characters (2.5 times at most), a sentence's end, the share of link text, and so on.
PRIOR = {"base": -0.6, "length": 1.0, "sentence": 0.8, "links": -4.0, "article": 2.5, "content": 1.2, "heading": 0.3, "list": -0.5, "marked": -6.0, "chrome": -9.0}
Weights = tuple[float, ...]
ADJACENT, SIBLING, INFINITE = 0.5, 1.0, 1e9


@dataclass
class Element:
    tag: str
    never: bool
    chrome: bool
    article: bool
    content: bool
    number: int
    marks: frozenset[tuple[int, bool]] = frozenset()  # numbers of marked elements around it, and whether articles leave the mark


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    never: bool = False
    chrome: bool = False
    article: bool = False
    content: bool = False
    tag: str = ""
    parent: int = 0
    text: str = ""
    marks: frozenset[tuple[int, bool]] = frozenset()


def element(tag: str, attributes: str, above: Element, number: int) -> Element:
    never, chrome = above.never or tag in NEVER, above.chrome or tag in CHROME or tag == "header" and not above.article
    article, content = above.article or tag in ("article", "main"), above.content
    marked, sticky = tag == "form", False
    if tag not in ("html", "body") and attributes.strip():
        words: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true":
                never = True
            elif name != "aria-hidden":
                words.update(w.lower() for token in value.split() if not STATE.match(token) for w in WORDS.findall(token))
        marked = marked or bool(words & NEVER_WORDS) and not (tag in ("article", "main") and not words & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"})
        content = content or bool(words & CONTENT_WORDS)
        marked = marked or bool(words & HEADER_WORDS) and not above.article
        sticky = bool(words & STICKY_WORDS)
    marks = above.marks
    if marked:
        marks |= {(number, sticky)}
    elif tag in ("article", "main"):
        marks = frozenset(m for m in marks if m[1])
    return Element(tag, never, chrome, article, content, number, marks)


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    stack = [Element("", False, False, False, False, 0)]
    out: list[Block] = []
    now: Block | None = None
    number, at, links = 0, 0, 0

    def add(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            if not text.strip():
                return
            top = stack[-1]
            holder = next((e for e in reversed(stack) if e.tag not in INLINE), stack[0])
            outer = next((e for e in reversed(stack) if e.tag not in INLINE and e is not holder), stack[0])
            now = Block(never=top.never, chrome=top.chrome, article=top.article, content=top.content, tag=holder.tag, parent=outer.number, marks=top.marks)
            out.append(now)
        now.never = now.never and stack[-1].never
        now.chrome = now.chrome and stack[-1].chrome
        now.marks &= stack[-1].marks
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def close(upto: int) -> None:
        nonlocal links, now
        for e in stack[upto:]:
            links -= e.tag == "a"
            if e.tag not in INLINE:
                now = None
        del stack[upto:]

    while True:
        m = TAG.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end: closes the nearest open one, and what is open in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline end doesn't close blocks
            if tag not in INLINE:
                now = None
            continue
        if tag not in INLINE:
            now = None if tag != "br" else now
            if tag == "br":
                add(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if kinds := CLOSES.get(tag):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in kinds:
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        elif tag not in INLINE:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag == "body":  # the head is over, closed or not
            close(next((i for i, e in enumerate(stack) if e.tag == "head"), len(stack)))
        number += 1
        stack.append(element(tag, m[3], stack[-1], number))
        links += tag == "a"
    for b in out:
        raw = "".join(b.parts)
        b.text = " ".join(html.unescape(raw).split())
        b.linked = b.linked / max(1, len(raw))
    return unmarked([b for b in out if b.text])


def unmarked(blocks: list[Block]) -> list[Block]:
    """The blocks, without the marks of elements that hold most of the page's text, if no article is outside them."""
    open_ = [b for b in blocks if not b.never and not b.chrome]
    if not any(b.marks for b in open_) or any(not b.marks and (b.article or b.content) for b in open_):
        return blocks
    held: dict[tuple[int, bool], float] = {}
    for b in open_:
        for m in b.marks:
            held[m] = held.get(m, 0.0) + len(b.text) * (1 - b.linked)
    half = sum(len(b.text) * (1 - b.linked) for b in open_) / 2
    void = frozenset(m for m, n in held.items() if n > half)
    for b in open_:
        b.marks -= void
    return blocks


def features(b: Block, article: bool = True) -> Weights:
    """A block's features, in the order of PRIOR. article: whether to look at the element of that name."""
    article = article and b.article
    sentence = any(c in b.text for c in ".!?。")
    return (1.0, min(len(b.text) / 80, 2.5), float(sentence), b.linked, float(article), float(b.content and not article), float(b.tag in ("h1", "h2", "h3")), float(b.tag == "li" and not article), float(bool(b.marks)), float(b.chrome))


def preference(b: Block, weights: Weights) -> float:
    """Log-odds for content by the classifier; minus infinity for what is no text."""
    return -INFINITE if b.never else sum(map(mul, weights, features(b)))


def learned(rows: list[tuple[float, ...]], evidence: float = 200.0, spread: float = 2.0) -> Weights:
    """The most likely weights: of logistic regression on rows (features, label, how often), which count as `evidence` in all, with a normal prior around PRIOR."""
    prior = np.array(list(PRIOR.values()))
    if not rows:
        return tuple(prior.tolist())
    data = np.array(rows, dtype=np.float64)
    x, y, n = data[:, :-2], data[:, -2], data[:, -1] * (evidence / data[:, -1].sum())
    w = prior.copy()
    for _ in range(50):  # Newton's steps, halved where they don't help
        loss = lambda w: float((n * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + ((w - prior) ** 2).sum() / (2 * spread**2))
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(w)) / spread**2, x.T @ (n * (p - y)) + (w - prior) / spread**2)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if abs(size * step).max() < 1e-8:
            break
    return tuple(w.tolist())


def labelled(page: str | None) -> list[tuple[float, ...]]:
    """Features and label of the blocks of a page that has an article, with the article as a feature and without."""
    found = [b for b in blocks_of(page or "") if not b.never]
    if not any(b.article for b in found):
        return []
    return [(*features(b, see), float(b.article and not b.chrome and not b.marks)) for b in found for see in (True, False)]


def train(pages: DataFrame, page: str = "html", key: str = "page_id", sample_pages: int = 1000) -> Weights:
    """Weights learned from at most `sample_pages` pages (those with the smallest hashes of `key`) that have an article element.

    Features are rounded to a tenth and rows that are alike are counted in the executors, so that the driver gets few.
    """
    rows = smallest(pages.where(F.col(f"`{page}`").rlike("(?i)<(article|main)[\\s>]")), key, sample_pages)
    if rows is None:
        return learned([])
    names = [*PRIOR, "label"]

    def work(batch: dict) -> dict:
        counts = Counter(tuple(round(v, 1) for v in r) for p in batch[page] for r in labelled(p))
        return {c: [r[i] for r in counts] for i, c in enumerate(names)} | {"n": list(counts.values())}

    found = map_rows(rows, [page], ", ".join(f"`{c}` double" for c in names) + ", n long", lambda: work)
    return learned(sorted(tuple(r) for r in found.groupBy(*names).agg(F.sum("n").cast("double").alias("n")).collect()))


def min_cut(prefer: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut. prefer: source capacity less sink capacity."""
    n = len(prefer)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    prefer, side = list(prefer), [None] * n
    todo = list(range(n))
    while todo:  # decided by their own cost
        i = todo.pop()
        if side[i] is None and abs(prefer[i]) >= sum(near[i].values()):
            side[i] = prefer[i] > 0
            for j, w in near[i].items():
                if side[j] is None:
                    prefer[j] += w if side[i] else -w
                    del near[j][i]
                    todo.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        reached = _max_flow(left, prefer, near)
        for i in left:
            side[i] = i in reached
    return side


def _max_flow(nodes: list[int], prefer: list[float], near: list[dict[int, float]]) -> set[int]:
    """Blocking flows along levels of distance from the source; gives the nodes that the source still reaches."""
    at = {i: x for x, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    heads: list[list[int]] = [[] for _ in range(sink + 1)]  # of each node, its edges; an edge's reverse is its number ^ 1
    to: list[int] = []
    room: list[float] = []

    def connect(i: int, j: int, there: float, back: float) -> None:
        for x, y, r in ((i, j, there), (j, i, back)):
            heads[x].append(len(to))
            to.append(y)
            room.append(r)

    for i in nodes:
        if prefer[i] > 0:
            connect(source, at[i], prefer[i], 0.0)
        elif prefer[i] < 0:
            connect(at[i], sink, -prefer[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                connect(at[i], at[j], w, w)
    while True:
        level = [-1] * len(heads)
        level[source], queue = 0, deque([source])
        while queue:
            i = queue.popleft()
            for e in heads[i]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return {i for i in nodes if level[at[i]] >= 0}
        todo = [list(h) for h in heads]
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(x for x, e in enumerate(path) if room[e] <= 1e-12)
                i = to[path[cut] ^ 1]
                del path[cut:]
            while todo[i]:
                e = todo[i][-1]
                if room[e] > 1e-12 and level[to[e]] == level[i] + 1:
                    path.append(e)
                    i = to[e]
                    break
                todo[i].pop()
            else:
                if i == source:
                    break
                i = to[path.pop() ^ 1]
                todo[i].pop()


def main_text(page: str | None, weights: Weights = tuple(PRIOR.values())) -> str:
    """The blocks of the content side, joined by one space."""
    found = blocks_of(page or "")
    edges = [(i, i + 1, ADJACENT) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    side = min_cut([preference(b, weights) for b in found], edges)
    return " ".join(b.text for b, content in zip(found, side, strict=True) if content)


def extract(pages: DataFrame, page: str = "html", columns: tuple[str, ...] = ("page_id", "url"), weights: Weights | None = None) -> DataFrame:
    """`columns` of pages, text, n_chars. Without weights they are learned from pages, whose first column of `columns` is the key."""
    weights = train(pages, page, columns[0]) if weights is None else weights
    kinds = dict(pages.select(*[F.col(f"`{c}`") for c in columns]).dtypes)

    def make():
        def work(batch: dict) -> dict:
            texts = [main_text(p, weights) for p in batch[page]]
            return {c: batch[c] for c in columns} | {"text": texts, "n_chars": list(map(len, texts))}

        return work

    return map_rows(pages, [*columns, page], ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", text string, n_chars long", make)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages."""
    return extract(table(spark, sf_dir, "pages"))

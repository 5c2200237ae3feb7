"""Main text of web pages by the maximum-scoring run of words and tags.

A page becomes a row of tokens, texts and tags.  Weights come from labelled pages, as log-odds
of content: of words below each kind of element (its name, and the words of its class, id and
role), of words in blocks with few or many links, and of tags.  A word scores a base weight,
less what the nearest element with a weight says against it, less what its block's links say
(unless that element speaks for it); the class, id or role of an element that wraps the page's
text is not held against it (``Weights.judged``).  Every tag costs something.

One linear scan finds the run of tokens with the highest sum (Kadane's), from which whole
blocks may be left out at a price: so an advert or a form amid the article, whose words score
below zero, costs the same however long it is, and ends no article.  Nothing else picks or
drops words.  Of equal sums the longer run counts, so that nothing without a score against it
is lost at the edges.

Scripts, styles, comments and the like are no tokens.  Character references are decoded,
white space (Unicode's) inside a block becomes one space, and blocks are joined by one line feed.
Reading and scanning take time in proportion to the page.

Edge cases: null or empty html, and pages without a word that scores, give an empty text;
a page that breaks off inside a tag, comment or script ends there; unclosed elements, hidden
ones too, end with what encloses them, and self-closed ones are empty; repeated rows give repeated results; an empty table gives none;
other columns are never read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Elements whose content is no markup, and runs to their end tag or the page's end.
RAW = ("script", "style", "noscript", "iframe", "title", "textarea")
#: Other elements whose text is not shown, or that only hold controls; unclosed ones end with what encloses them.
HIDDEN = frozenset(("template", "svg", "math", "object", "canvas", "select", "button", "audio", "video"))
#: A start tag of a block ends the first, unless it is inside one of the second.
FOREIGN, EMBEDDED = ("svg", "math"), ("foreignobject", "desc", "annotation-xml")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: A start tag of a block ends an open paragraph; these end one of their own kind.
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORDS = re.compile(r"[^\W_]+")

#: Elements that mean something else inside sections of the page.
INNER, SECTIONS = ("header", "footer"), ("article", "main")
#: A word's score before evidence, bounds of log-odds and of a tag's cost, and the price of a block that
#: is left out of a run. Both are small beside a word, so that no paragraph of one word is a loss.
BASE, LIMIT = 1.0, 4.0
LEAST_OF_TAG, MOST_OF_TAG, LEFT_OUT = 0.02, 0.1, 0.2


@dataclass(eq=False)
class Element:
    """An open element: its own kinds, what is around it, and its tokens."""

    name: str
    own: frozenset
    outer: Element | None
    hidden: bool
    begin: int = 0  # of its first token, and after its last
    end: int = 0
    words: int = 0  # below it, in all and below holders; see Weights.judged
    held: int = 0
    holds: bool = False
    counted: bool = True
    evidence: float = 0.0


@dataclass
class Token:
    """A text between two tags (``text``), or the start or end of an element."""

    block: int
    element: Element | None
    text: str | None = None
    tag: str = ""
    closes: bool = False
    words: int = 0
    score: float = 0.0


def kinds_of(name: str, attributes: str) -> frozenset:
    found = {name}
    if attributes and len(attributes) > 3:
        for m in NAMED.finditer(attributes):
            found.update("." + w for w in WORDS.findall((m[1] or m[2] or m[3] or "").lower().replace("_", " ")))
    return frozenset(found)


class Stack:
    """Open elements, and where those of each name and those that end a search stand; every step
    takes time for what it opens or closes, however deep the stack is."""

    BARRIERS = BLOCKS | HIDDEN | set(EMBEDDED)

    def __init__(self):
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []

    def push(self, e: Element) -> None:
        self.places.setdefault(e.name, []).append(len(self.open))
        if e.name in self.BARRIERS:
            self.barriers.append(len(self.open))
        self.open.append(e)

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, at: int) -> list[Element]:
        """Closes all from a place on, the innermost first."""
        out = []
        while len(self.open) > at:
            e = self.open.pop()
            self.places[e.name].pop()
            if self.barriers and self.barriers[-1] == len(self.open):
                self.barriers.pop()
            out.append(e)
        return out


def parsed(page: str) -> tuple[list[Token], list[Element]]:
    """Tokens of a page in order, and its elements, outer ones first."""
    out: list[Token] = []
    elements: list[Element] = []
    stack = Stack()
    block, at = 0, 0

    def inner() -> Element | None:
        return stack.open[-1] if stack.open else None

    def closed(place: int, tag: str = "") -> None:
        nonlocal block
        for e in stack.cut(place):
            if not e.hidden:
                # Only the end tag that stands there is a token with a weight.
                written = tag == e.name and len(stack.open) == place
                if e.name in BLOCKS:
                    block += 1
                out.append(Token(block, e, None, e.name if written else "", True))
            e.end = len(out)

    def text(to: int) -> None:
        e = inner()
        if to > at and not (e and e.hidden):
            words = len(page[at:to].split())
            out.append(Token(block, e, page[at:to], words=words))

    for m in TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if (k := stack.last(name)) >= 0:
                closed(k, name)
            elif name in BLOCKS and not (inner() and inner().hidden):
                block += 1
            continue
        if name in BLOCKS:
            # Blocks end foreign elements, unless they are embedded in them, and an open paragraph.
            if (k := stack.last(*FOREIGN)) > stack.last(*EMBEDDED):
                closed(k)
            if (k := stack.last("p")) >= 0 and k >= (stack.barriers[-1] if stack.barriers else -1):
                closed(k)
        if name in SELF_CLOSING and (k := stack.last(name)) > stack.last(*SELF_CLOSING[name]):
            closed(k)
        outer = inner()
        hidden = bool(outer and outer.hidden)
        if name in VOID or m[4].endswith("/>"):
            if not hidden and name not in HIDDEN:
                block += name in BLOCKS
                out.append(Token(block, outer, None, name))
                if name in ("br", "td", "th"):
                    out.append(Token(block, outer, " "))
            continue
        if name in INNER and any(stack.places.get(n) for n in SECTIONS):
            own = kinds_of("inner " + name, m[4])
        else:
            own = kinds_of(name, m[4])
        e = Element(name, own, outer, hidden or name in HIDDEN, len(out))
        stack.push(e)
        elements.append(e)
        if not e.hidden:
            block += name in BLOCKS
            out.append(Token(block, e, None, name))
            if name in ("td", "th"):
                out.append(Token(block, e, " "))
    text(len(page))
    closed(0)
    return out, elements


def link_share(tokens: list[Token]) -> dict[int, float]:
    """Of each block, the share of its words that are links."""
    linked, total, inside = Counter(), Counter(), 0
    for t in tokens:
        if t.text is None:
            if t.element and t.element.name == "a" and (t.closes or t.tag == "a"):
                inside += -1 if t.closes else 1
        elif t.words:
            total[t.block] += t.words
            linked[t.block] += t.words * (inside > 0)
    return {b: linked[b] / n for b, n in total.items()}


def link_class(share: float) -> int:
    return 0 if share == 0 else 1 if share <= 0.5 else 2


@dataclass
class Weights:
    kinds: dict[str, float]  # log-odds of words below: of kinds that never hold content, and of holders
    links: tuple  # of words of blocks by their share of links
    tags: dict[str, float]
    holders: frozenset = frozenset()  # kinds that held all content of a page, and nothing else anywhere

    def of(self, own: frozenset, wraps: bool = False) -> float:
        """What an element's kinds say: the most that any says against, or else for, its words.
        Of an element that wraps the page's text its class, id and role say nothing."""
        said = [self.kinds[k] for k in own if k in self.kinds and not (wraps and k.startswith("."))]
        return min((x for x in said if x < 0), default=max(said, default=0.0))

    def judged(self, tokens: list[Token], elements: list[Element]) -> None:
        """Evidence of every element: its own, or else that of the nearest around it."""
        for e in elements:
            against = [k for k in e.own if self.kinds.get(k, 0.0) < 0]
            e.counted = (e.outer is None or e.outer.counted) and all(k.startswith(".") for k in against)
            e.holds = bool(e.outer and e.outer.holds) or bool(e.own & self.holders and not against)
            e.words = e.held = 0
        total = held = 0
        for t in tokens:
            if t.words and (t.element is None or t.element.counted):
                total += t.words
                if t.element:
                    t.element.words += t.words
                    t.element.held += t.words * t.element.holds
                    held += t.words * t.element.holds
        for e in reversed(elements):
            if e.outer:
                e.outer.words += e.words
                e.outer.held += e.held
        for e in elements:
            wraps = (e.held == held and 2 * e.words >= total) if held else 5 * e.words >= 4 * total
            said = self.of(e.own, bool(total) and wraps)
            e.evidence = said or (e.outer.evidence if e.outer else 0.0)

    def score(self, tokens: list[Token]) -> None:
        shares, unknown = link_share(tokens), min(self.tags.values(), default=0.0)
        for t in tokens:
            said = t.element.evidence if t.element else 0.0
            if t.text is None:
                t.score = self.tags.get(t.tag, unknown) if t.tag else 0.0
            elif t.words:
                # A holder vouches for its links.
                one = BASE + min(said, 0.0) + (self.links[link_class(shares[t.block])] if said <= 0 else 0.0)
                t.score = t.words * one


def fit(labelled) -> Weights:
    """``labelled``: pairs of a page and the blocks of its main text.  All weights are log-odds of
    content, by words or tags; what holds content somewhere isn't held against the words below it."""
    inside, outside, tag_in, tag_out = Counter(), Counter(), Counter(), Counter()
    links_in, links_out = Counter(), Counter()
    around_all: set = set()
    others: list[tuple[Element | None, int]] = []
    for page, blocks in labelled:
        wanted = {" ".join(b.split()) for b in blocks}
        tokens, _ = parsed(page)
        whole: dict[int, str] = {}
        for t in tokens:
            if t.text is not None:
                whole[t.block] = whole.get(t.block, "") + t.text
        content = {b for b, x in whole.items() if " ".join(html.unescape(x).split()) in wanted}
        shares, common_kinds = link_share(tokens), None
        for t in tokens:
            mine = t.block in content
            if t.text is None:
                (tag_in if mine else tag_out)[t.tag] += 1
            elif t.words:
                (links_in if mine else links_out)[link_class(shares[t.block])] += t.words
                if not mine:
                    others.append((t.element, t.words))
                    continue
                around = {k for e in outwards(t.element) for k in e.own}
                for k in around:
                    inside[k] += t.words
                common_kinds = around if common_kinds is None else common_kinds & around
        around_all |= common_kinds or set()
    # Other words count for what is around them up to the first element that never holds content.
    for e, words in others:
        for e in outwards(e):
            for k in e.own:
                outside[k] += words
            if any(not inside[k] for k in e.own):
                break
    odds = lambda a, b: max(-LIMIT, min(LIMIT, math.log((a + 0.5) / (b + 0.5))))
    holders = frozenset(k for k in around_all if not outside[k])
    kinds = {k: odds(inside[k], outside[k]) for k in inside.keys() | outside.keys() if not inside[k] or k in holders}
    total = odds(sum(links_in.values()), sum(links_out.values()))
    links = tuple(min(0.0, odds(links_in[k], links_out[k]) - total) for k in range(3))
    tags = {k: max(-MOST_OF_TAG, min(-LEAST_OF_TAG, odds(tag_in[k], tag_out[k]))) for k in tag_in.keys() | tag_out.keys() if k}
    return Weights(kinds, links, tags, holders)


def outwards(e: Element | None):
    """An element and those around it."""
    while e:
        yield e
        e = e.outer


def best_run(tokens: list[Token]) -> tuple[float, list[int]]:
    """The highest score of a run of tokens less the blocks left out of it, each at the price
    ``LEFT_OUT``; and the places of its tokens.  Of runs with one score, the longest.

    One pass: ``now`` is the best run that ends here, and at the end of a block it may be the one
    that ended before the block, with the block left out."""
    now, begin, left = 0.0, 0, None  # left: what was left out, as (first, after, what before)
    best, first, last, skipped = 0.0, 0, 0, None
    before: list[tuple[Element, float, int, tuple | None]] = []
    for i, t in enumerate(tokens):
        if now < 0:
            now, begin, left = 0.0, i, None
        if t.text is None and t.element and t.element.name in BLOCKS and not t.closes and t.element.begin == i:
            before.append((t.element, now, begin, left))
        now += t.score
        if t.closes and before and before[-1][0] is t.element:
            e, old, old_begin, old_left = before.pop()
            if old > 0 and old - LEFT_OUT > now:
                now, begin, left = old - LEFT_OUT, old_begin, (e.begin, i + 1, old_left)
        if now > best or (now == best and best > 0 and i + 1 - begin > last - first):
            best, first, last, skipped = now, begin, i + 1, left
    places, at = [], last
    while skipped:
        begin, end, skipped = skipped
        places.append(range(end, at))
        at = begin
    places.append(range(first, at))
    return best, [i for part in reversed(places) for i in part] if best > 0 else []


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    tokens, elements = parsed(page)
    weights.judged(tokens, elements)
    weights.score(tokens)
    blocks: dict[int, list[str]] = {}
    for i in best_run(tokens)[1]:
        if tokens[i].text is not None:
            blocks.setdefault(tokens[i].block, []).append(tokens[i].text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _page(*parts: str) -> str:
    return "<!DOCTYPE html><html><head><title>A title</title></head><body>" + "".join(parts) + "</body></html>"


#: Labelled pages: html, and the blocks that are its main text.
LABELLED = [
    (
        _page(
            '<header class="site-header masthead"><a href="/">The Daily Example</a></header><nav class="menu navbar"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport and weather</a></li></ul></nav>',
            '<div class="ad advert">Buy one and get another one free today</div><article class="post"><h1>Storm crosses the bay</h1><p>The storm crossed the bay <b>early</b> on Monday and left by noon.</p><p>Nobody was <a href="/x">hurt</a>, the harbour said.</p></article>',
            '<aside class="sidebar related"><h3>Related stories</h3><ul><li><a href="/1">Ten storms to remember</a></li></ul></aside><footer class="footer">&copy; 2020 Daily Example, all rights reserved</footer>',
        ),
        ["Storm crosses the bay", "The storm crossed the bay early on Monday and left by noon.", "Nobody was hurt, the harbour said."],
    ),
    (
        _page(
            '<div id="cookie-banner" class="cookie consent notice">We use cookies to make this site better. <button>Accept</button></div><div class="breadcrumb breadcrumbs"><a href="/">Home</a> / <a href="/r">Recipes</a></div>',
            '<main class="content main"><h1>Plain bread</h1><p>Mix flour, water and salt.</p><ul><li>500 g flour</li><li>10 g salt</li></ul><blockquote>Bread needs time.</blockquote><p>Bake it for <em>forty</em> minutes.</p></main>',
            '<form class="newsletter subscribe signup"><label>Your address</label> Subscribe to our letters</form><section class="comments comment-list" id="comments"><h2>Comments</h2><div class="comment"><p>Came out very well, thank you!</p></div></section>',
        ),
        ["Plain bread", "Mix flour, water and salt.", "500 g flour", "10 g salt", "Bread needs time.", "Bake it for forty minutes."],
    ),
    (
        _page(
            '<div class="topbar navigation" role="navigation"><a href="/login">Log in</a> <a href="/join">Join us</a></div><div class="promo banner sponsored sponsor">Sponsored: the best shoes of the season</div>',
            '<div class="entry article-body text story"><h2>How tides work</h2><p>The moon pulls the water on the near side a little more.</p><table><tr><td>High water</td><td>six hours</td></tr></table><pre>rise and fall</pre></div>',
            '<div class="share social">Share this page with your friends</div><div class="pagination pager"><a href="?p=2">Next page</a></div><div class="disqus discussion reply respond replies">I never knew that, great read</div><div class="legal copyright credits">Terms and privacy</div>',
        ),
        ["How tides work", "The moon pulls the water on the near side a little more.", "High water six hours", "rise and fall"],
    ),
    (
        _page(
            '<div class="popup modal overlay alert">Sign up now to read more</div><div class="widget widgets tags toc skip">On this page: first, second</div>',
            '<section class="section body"><h1>A walk in the hills</h1><h3>Morning</h3><p>We left at <span>six</span> and <i>walked</i> until <strong>ten</strong>.<br>It was cold.</p><dl><dt>Height</dt><dd>900 metres</dd></dl><figure><figcaption>The last hut</figcaption></figure></section>',
            '<div class="ads adsbygoogle advertisement adverts">Cheap flights to the hills</div><div class="author byline meta">By A. Writer, 3 May</div><div class="recommended recommendations more trending popular">Read next: a walk by the sea</div><div role="complementary banner contentinfo search">Search this site</div>',
        ),
        ["A walk in the hills", "Morning", "We left at six and walked until ten. It was cold.", "Height", "900 metres", "The last hut"],
    ),
    (
        _page(
            '<div><div><a href="/">Town library</a></div><ul><li><a href="/o">Opening hours</a></li><li><a href="/c">Catalogue</a></li><li><a href="/e">Events</a></li></ul></div>',
            '<article><header><h1>New reading room</h1></header><p>The library opens a reading room on the second floor, with a view over the square.</p><p>It has <a href="/s">sixty seats</a> and twelve desks; none of them can be booked.</p><footer>Filed under news, buildings</footer></article>',
            '<div><a href="/1">Older entries</a> <a href="/2">Newer entries</a></div><div><p><a href="/i">Imprint</a> <a href="/p">Privacy</a></p></div>',
        ),
        ["New reading room", "The library opens a reading room on the second floor, with a view over the square.", "It has sixty seats and twelve desks; none of them can be booked."],
    ),
]


def extract_pages(pages: DataFrame, labelled=None, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``id``, ``keep``, ``text`` and ``n_chars`` of every page."""
    held = pages.sparkSession.sparkContext.broadcast(fit(LABELLED if labelled is None else labelled))

    def make():
        def work(column):
            texts = [extract(p, held.value) for p in column.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return common.map_texts(pages, make, [("text", T.StringType()), ("n_chars", T.LongType())], id_col, html_col, keep=keep)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages"), keep=["url"])

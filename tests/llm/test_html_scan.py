"""The scan against brute force, names that no labelled page has, and long pages."""

import re
import time

import numpy as np
import pytest

from hexalloc.llm import html_text

W = html_text.fit(html_text.LABELLED)


def brute(tokens):
    """The highest score over all runs and all sets of blocks left out of them."""
    whole = {t.element.begin: t.element for t in tokens if t.element and t.element.name in html_text.BLOCKS}

    def most(i, j):
        """All ways through the tokens from i to j."""
        if i == j:
            return 0.0
        best = tokens[i].score + most(i + 1, j)
        if i in whole and whole[i].end <= j:
            best = max(best, most(whole[i].end, j) - html_text.LEFT_OUT)
        return best

    return max([0.0, *(most(i, j) for i in range(len(tokens)) for j in range(i + 1, len(tokens) + 1))])


def test_scan_against_brute_force():
    rng = np.random.default_rng(3)
    left_out = 0
    for _ in range(400):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "a ", "b c ", "<br>"], rng.integers(1, 12)))
        tokens, _ = html_text.parsed(page)
        for t in tokens:
            t.score = float(rng.choice([-3, -1, -0.1, 0, 0.5, 1, 2]))
        score, places = html_text.best_run(tokens)
        assert score == pytest.approx(brute(tokens)), page
        # The tokens given are worth the score, at the price of what is missing between them.
        gaps = sum(b > a + 1 for a, b in zip(places, places[1:]))
        left_out += gaps
        assert sum(tokens[i].score for i in places) - html_text.LEFT_OUT * gaps >= score - 1e-9
    assert left_out > 20


ARTICLE = "<h1>Storm</h1><p>The storm crossed the bay early on Monday and left by noon of the next day.</p><p>Nobody was hurt, the harbour said in a long statement.</p>"
LINES = ["Storm", "The storm crossed the bay early on Monday and left by noon of the next day.", "Nobody was hurt, the harbour said in a long statement."]
CASES = [
    # menus and link lists below names that no labelled page has
    (f'<div class="zq1"><ul><li><a href=1>Home</a></li><li><a href=2>World news</a></li></ul></div><div class="zq2">{ARTICLE}</div><div class="zq3"><a>About us</a> <a>Contact us</a></div>', LINES),
    (f'<table><tr><td><a href=1>One</a><td><a href=2>Two</a></table>{ARTICLE}<p><a>Next</a> | <a>Previous</a>', LINES),
    # a holder vouches for its links
    (f"<nav><a>Menu</a></nav><article>{ARTICLE}<ul><li><a href=3>The statement</a></li></ul></article>", [*LINES, "The statement"]),
    # a header of the article is text, one of the page isn't; neither is any footer
    (f"<header><p>The Example</p></header><article><header>{ARTICLE}</header><footer>Filed under storms</footer></article><footer>Some words</footer>", LINES),
    # blocks that speak against their words cost the same however long they are
    ("<article><p>One.</p><div class=advert>" + "buy " * 500 + f"</div>{ARTICLE}<form><p>Your name</p></form><p>End.</p></article>", ["One.", *LINES, "End."]),
    # the nearest name counts
    (f'<div class="related-page"><article>{ARTICLE}<div class="sidebar"><p class="text">text</p><p>More stories</p></div></article></div><p>x</p>', [*LINES[:3], "text", "x"]),
]


@pytest.mark.parametrize("page,lines", CASES)
def test_unseen_names_and_nearest_names(page, lines):
    assert html_text.extract(f"<html><body>{page}</body></html>", W).split("\n") == lines


@pytest.mark.parametrize("unit", ["<b></x>", "<b><div></div>", "<div><p>", "<p><b>x", "<svg><p>", "<table><tr><td>", "<a href=x>y", "<li><i>", "<nav>x"])
def test_time_in_proportion(unit):
    took = []
    for n in (3_000, 24_000):
        began = time.process_time()
        html_text.extract(unit * n, W)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.3


def test_scan_decides_alone(spark):
    """No word is picked or dropped outside the scan: what it returns is the text."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        tokens, elements = html_text.parsed(r.html)
        W.judged(tokens, elements)
        W.score(tokens)
        places = html_text.best_run(tokens)[1]
        words = " ".join(tokens[i].text for i in places if tokens[i].text).split()
        assert re.sub(r"\s", "", html_text.extract(r.html, W)) == re.sub(r"\s", "", html_text.html.unescape("".join(words)))

"""Names of elements around a page's whole text don't empty it."""

import pytest

from hexalloc.llm import html_text

TEXT = "<p>One two three four.</p><p>Five six seven eight nine ten.</p>"
LINES = "One two three four.\nFive six seven eight nine ten."
CASES = [
    (f'<body class="has-sidebar">{TEXT}</body>', LINES),
    (f'<body class="has-sidebar"><header>Site name</header><div id="page" class="site"><div>{TEXT}</div><div class="sidebar">no no</div></div><footer>no</footer></body>', LINES),
    (f'<div id="page" class="site"><nav>a b c</nav><article>{TEXT}<div class="advert">{"buy " * 8}</div></article><div class="related"><p>no no</p></div></div>', LINES),
    (f'<div class="list more">{TEXT}</div>', LINES),
    (f'<article>{TEXT}</article><div class="comments">{"no " * 90}</div>', LINES),
    ("<nav class=menu>a b</nav>", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_wrappers(page, text):
    assert html_text.extract(page, html_text.fit(html_text.LABELLED)) == text

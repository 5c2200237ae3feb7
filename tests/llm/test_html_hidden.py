"""Hidden elements hide their own content, and nothing after it."""

import pytest

from hexalloc.llm import html_text

CASES = [
    ('<p>a <svg class="i"/> b</p><p>rest</p>', "a b\nrest"),
    ("<p>a <math/> b</p><p>rest</p>", "a b\nrest"),
    ("<p>a <svg><path d='M 0'/><title>icon</title><text>no</text></svg> b</p><p>rest</p>", "a b\nrest"),
    ("<p>a <svg-icon></svg-icon> b</p><p>rest</p>", "a b\nrest"),
    ("<div><video-player></video-player><title-bar>x</title-bar><p>rest</p></div>", "x\nrest"),
    ("<div><p>a <button>no</p><p>b</p></div><p>rest</p>", "a\nb\nrest"),
    ("<div><p>a</p><div><select><option>no<option>no</div><p>b</p></div>", "a\nb"),
    ("<div><p>a</p><div><audio src=x></div><p>b</p></div>", "a\nb"),
    ("<p>a <svg><path><p>b</p>", "a\nb"),
    ("<p>a <svg><foreignObject><div>no</div></foreignObject></svg> b</p>", "a b"),
    ("<p>a <button><div>no</div></button> b</p>", "a b"),
    ("<p>a <object><embed><p>no</p></object>", "a"),
    ("<p>a<script/>no <p>no</script> b</p>", "a b"),
    ("<p>a<TEMPLATE><p>no</p></TEMPLATE > b</p>", "a b"),
    ("<p>a <video><source src=x>no", "a"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_hidden_elements(page, text):
    assert html_text.extract(page, html_text.fit(html_text.LABELLED)) == text

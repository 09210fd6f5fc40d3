"""Selectors: what they take, by examples and against a plain matcher."""

import pytest

from factloom.config import Settings, settings_from
from factloom.sources import pages as P
from factloom.sources import selectors as S

STACK = [("html", {}), ("body", {"class": "page wide"}), ("main", {"id": "m"}), ("div", {"class": "box compare-funds", "data-testid": "x-compare-y"}), ("p", {"lang": None, "title": "a b"})]


@pytest.mark.parametrize(
    ("selector", "takes"),
    [
        ("p", True), ("P", True), ("div", False), ("*", True), ("div p", True), ("div > p", True), ("main p", True), ("main > p", False), ("body > main > div > p", True), ("body main > p", False), ("html body p", True), ("p div", False),
        (".box p", True), (".compare-funds>p", True), (".compare p", False), ("div.box.compare-funds p", True), ("div.box.other p", False), ("#m p", True), ("main#m > .box > p", True), ("#n p", False),
        ("[data-testid*='compare'] p", True), ("[data-testid^=x] p", True), ('[data-testid$="-y"] p', True), ("[data-testid=x] p", False), ("[data-testid] > [title~=b]", True), ("[title~='a b']", False), ("[lang]", True), ("[lang='']", True), ("[lang*='']", False),
        ("h1, p", True), ("h1 , div > h2", False), ("aside,nav,main p", True),
    ],
)
def test_paths(selector, takes):
    assert any(path.takes(STACK) for path in S.compiled(selector)) == takes and S.Matcher([selector]).takes(STACK) == takes


@pytest.mark.parametrize("text", ["", ">", "p >", "p,", "[a", "[a='b]", "p:first-child", "..x", "p > > a", "p[x!=y]"])
def test_what_is_no_selector(text):
    with pytest.raises(S.BadSelector):
        S.compiled(text)
    assert not S.Matcher([text]).takes(STACK) and S.Matcher([text, "p"]).takes(STACK)


def test_settings_decide_what_is_dropped():
    page = "<body><nav>menu</nav><main><h1>Title</h1><div class='x return-calculator-2'>calc</div><p class=lead>Text <b>bold</b></p><section data-testid='a-compare'>cmp</section></main></body>"
    assert P.dom_text_of(page) == "Title\nText\nbold"
    assert P.dom_text_of(page, ()) == "Title\ncalc\nText\nbold\ncmp"
    assert P.dom_text_of(page, ("main > .lead", "h1", "bad[")) == "calc\ncmp"
    assert settings_from({"drop_selectors": ["nav"]}).drop_selectors == ("nav",) and len(Settings().drop_selectors) == 7


def test_deep_pages_are_matched_without_recursion():
    assert P.dom_text_of("<div>" * 3000 + "deep" + "<p>x</p>" + "</div>" * 3000, ("div p",)) == "deep"

"""Rare markup that must not swallow the page's text."""

from __future__ import annotations

import pytest

from barloom.llm.html_extract import main_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>one</p><img alt=Don't><p>two isn't here</p>", "one two isn't here"),
        ("<p>one</p><img alt=5\"><p>two</p><img alt=6\"><p>three</p>", "one two three"),
        ("<p>one</p><div class=\"x\"\"><p>two</p></div><p id='a'>three</p>", "one two three"),
        ("<p>one</p><img alt = 'a > b' title=\"c > d\"><p>two</p>", "one two"),
        ("<p>one</p><a href=x=\"1><b>two</b></a><p>three \"</p>", 'one two three "'),
        ('<p>one</p><svg viewBox="0 0 1 1"/><p>two</p><svg><text>no</text></svg><p>three</p>', "one two three"),
        ("<p>one</p><math /><p>two</p>", "one two"),
        *((f"<p>one</p><{tag}><p>two</p>", "one two") for tag in ("noscript", "template", "iframe", "svg", "math", "object", "select")),
        *((f"<p>one</p><{tag}><p>two</p>", "one") for tag in ("script", "style", "title", "textarea")),
        ("<p>one</p><p title='never closed>two", "one"),
    ],
)
def test_text_survives(page, text):
    assert main_text(f"<body><article>{page}") == text


def test_long_broken_tags_take_linear_time():
    assert main_text("<p>one</p><a " + "x= y' \" =" * 100_000) == "one"

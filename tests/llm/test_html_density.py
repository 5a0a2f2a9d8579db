"""The densest subtree is the article, whatever it and its surroundings are called."""

from __future__ import annotations

from barloom.llm.html_extract import main_text

P = "the quick brown fox jumps over the lazy dog while the old farmer counts all of his sheep"


def paragraphs(*names):
    return "".join(f"<p>{n} {P}</p>" for n in names)


def texts(*names):
    return " ".join(f"{n} {P}" for n in names)


def test_no_article_element():
    page = f'<body><nav><a href="/">home</a></nav><div class="layout has-sidebar"><h1>T</h1><div>{paragraphs("a", "b", "c")}</div></div><div class="sidebar"><p>more here</p></div></body>'
    assert main_text(page) == f"T {texts('a', 'b', 'c')}"


def test_two_articles_but_no_teasers():
    teasers = '<article><a href="/x">read this too</a></article><article><p>short one</p></article>'
    page = f"<body><main><article>{paragraphs('a', 'b')}</article><article>{paragraphs('c', 'd')}</article>{teasers}</main></body>"
    assert main_text(page) == texts("a", "b", "c", "d")


def test_an_articles_own_header_captions_and_formulas():
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><figure><img><figcaption>A caption</figcaption></figure>{paragraphs('a')}</article></body>"
    assert main_text(page) == f"Title Let x=2 A caption {texts('a')}"


def test_an_advert_without_a_name_beside_a_short_article():
    page = f'<body><div class="box-17">{P} {P}</div><article>{paragraphs("a")}</article></body>'
    assert main_text(page) == texts("a")


def test_long_comments_below_a_short_text():
    page = f'<body><div id="text">{paragraphs("a", "b")}</div><div class="comments">{paragraphs(*"cdefghij")}</div></body>'
    assert main_text(page) == texts("a", "b")

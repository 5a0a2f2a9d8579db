"""Classes and ids that look like those of menus or notices, around and beside an article."""

from __future__ import annotations

import pytest

from barloom.llm.html_extract import main_text

WORDS = "the quick brown fox jumps over the lazy dog while the old farmer counts all of his sheep in the long grass"
ARTICLE = " ".join(f"{i} {WORDS}." for i in range(12))
BLOCKS = "".join(f"<p>{i} {WORDS}.</p>" for i in range(12))
AROUND = '<nav><a href="/">home</a></nav>{}<div class="comments"><p>first comment, nice</p></div><footer>2024</footer>'


@pytest.mark.parametrize(
    "name",
    ["content has-sidebar", "layout--with-sidebar", "post no-comments", "page header-fixed", "entry-content share-enabled", "page sidebar", "header"],
)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>", '<div class="x">{}</div>'])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_a_class_around_the_article_does_not_remove_it(name, inner, tag):
    for attribute in ("class", "id"):
        page = AROUND.format(f'<{tag} {attribute}="{name}">{inner.format(BLOCKS)}</{tag}>')
        assert main_text(f"<html><body>{page}</body></html>") == ARTICLE


def test_a_class_around_the_texts_of_an_article_element():
    page = f'<body><article><h1>T</h1><div class="header">{BLOCKS}</div><div class="share">tell your friends</div></article></body>'
    assert main_text(page) == f"T {ARTICLE}"


def test_classes_beside_the_article_still_remove():
    page = f'<body><div class="wide sidebar"><p>{WORDS}</p></div><article>{BLOCKS}<span class="promo">buy <b>this</b></span></article><div id="related"><article><p>{WORDS}</p></article></div></body>'
    assert main_text(page) == ARTICLE


def test_captions_stay():
    page = f"<body><article>{BLOCKS}<figure><img src=x><figcaption>A fox.</figcaption></figure></article></body>"
    assert main_text(page) == f"{ARTICLE} A fox."

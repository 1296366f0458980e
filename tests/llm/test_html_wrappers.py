"""Articles in wrappers that are named like something else, broken pages in linear time."""

from __future__ import annotations

import time

import pytest

from profilebook.llm import html
from profilebook.llm.common import read

ARTICLE = "<h1>Head line</h1><p>" + "First words of the story. " * 8 + "</p><p>" + "Second part, longer than the first one. " * 9 + "</p>"
WANT = "Head line\n" + ("First words of the story. " * 8).strip() + "\n" + ("Second part, longer than the first one. " * 9).strip()
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>Other</a></li></ul></nav>"
COMMENTS = "<section id='comments'><article class='comment-body'><p>" + "I do not agree at all. " * 60 + "</p></article></section>"


@pytest.fixture(scope="module")
def weights(spark):
    return html.train(read(spark, "/root/testdata/sf0.01", "pages"))


@pytest.mark.parametrize("inner", ["article", "main", "div"])
@pytest.mark.parametrize("wrapper", ["<div class='page has-sidebar'>{}</div>", "<form action='/x'>{}</form>", "<div id='page-with-nav'>{}</div>",
                                     "<div class='share related'>{}</div>", "<dialog open>{}</dialog>", "<div role='dialog'>{}</div>", "{}"])
def test_wrapped_articles_are_kept(weights, inner, wrapper):
    page = f"<html><body>{MENU}{wrapper.format(f'<{inner}>{ARTICLE}</{inner}>')}<footer>About us</footer></body></html>"
    assert html.extract(page, weights) == WANT


def test_what_is_beside_or_inside_stays_out(weights):
    page = (f"<body>{MENU}<div class='page has-sidebar'><article>{ARTICLE}<div class='ad-slot'>Buy now</div><form>Mail <input></form></article>"
            f"<aside><article><p>Another story</p></article></aside>{COMMENTS}<div class='newsletter'>Sign up</div></div><footer>x</footer>")
    assert html.extract(page, weights) == WANT
    assert html.extract(f"<body><div class='related'>See also this</div><article>{ARTICLE}</article>", weights) == WANT


def test_formulas_objects_and_fallbacks_of_the_article(weights):
    page = f"<body><article>{ARTICLE}<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p><object>drawn</object> <noscript>a chart</noscript></p></article><noscript>Turn it on</noscript>"
    assert html.extract(page, weights) == WANT + "\nso x=2 holds\ndrawn a chart"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<p>" * 150_000 + "</div>" * 150_000, '<a b="' * 170_000, "<a b='x\" " * 120_000 + ">", "<!--" * 250_000,
                                  "<script>" * 120_000, "<" * 1_000_000, "<article><nav>" * 70_000, "<p>" * 30_000 + "</b></p>" * 90_000, "<i class=" * 110_000 + ">"])
def test_broken_pages_are_read_in_linear_time(page):
    began = time.time()
    assert isinstance(html.extract(page, {}), str)
    assert time.time() - began < 20

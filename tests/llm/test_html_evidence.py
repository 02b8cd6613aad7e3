"""Main text where names, forms and open heads are no reason to drop an article."""

from __future__ import annotations

import pytest

from tradewind.llm import html_text

PROSE = "It is the first of the many long lines that we have here, and this was not for you but for all of us, so it is in."
MORE = "There is more of it in the second of the lines, which was as long as the first and is on the page for all of you."
TEXT = f"{PROSE}\n\n{MORE}"
BODY = f"<p>{PROSE}</p><p>{MORE}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><main class='content has-sidebar'>{BODY}</main></body>",
        f"<body><div id='content' class='no-sidebar'>{BODY}</div></body>",
        f"<body><div class='elementor-widget-text-editor'><p>{PROSE}</p></div><div class='elementor-widget-text-editor'><p>{MORE}</p></div></body>",
        f"<body><form action='x'>{BODY}</form></body>",
        f"<body><form><div class='widget'>{BODY}</div><div class='comments'><p>{PROSE}</p></div></form></body>",
        f"<body><article class='widget'>{BODY}</article><div class='sidebar'><p>{PROSE}</p></div></body>",
        f"<html><head><title>x</title><body>{BODY}",
        f"<head><title>x</title><meta charset=utf-8><script>var a</script>\n{BODY}",
    ],
)
def test_articles_stay(page):
    assert html_text.main_text(page) == TEXT


def test_titles_stay_and_small_marked_elements_go():
    page = f"<article><div class='article-header'><h1>Title</h1></div>{BODY}<form>Name <input> {PROSE}</form></article><div class='comments'><p>{PROSE}</p></div>"
    assert html_text.main_text(page) == f"Title\n\n{TEXT}"


def test_words_right_in_an_open_head_end_it():
    assert html_text.main_text(f"<head><title>x</title>{PROSE}") == PROSE

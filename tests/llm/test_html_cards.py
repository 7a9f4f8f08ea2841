import pytest

from evispark.llm import html_text

PROSE = "A sentence of the text that goes on for a while, with <a href='/x'>a link</a> and more words in it. " * 6
PARTS = "".join(f"<h2>Part {i}</h2><p>{PROSE}</p>" for i in range(5))
CARD = "<article><h3>Another story</h3><p>" + "A short teaser of some other story, told in a few words. " * 2 + "</p></article>"


@pytest.mark.parametrize("page", [f'<html><body><div id="content">{PARTS}</div>{CARD}</body></html>', f'<html><body>{CARD}{CARD}<div><div id="content">{PARTS}</div></div></body></html>'])
def test_cards_never_replace_the_text(page):
    text = html_text.main_text(page)
    assert all(f"Part {i}\nA sentence of the text" in text for i in range(5))


def test_article_is_still_preferred_to_what_stands_beside_it():
    page = f"<html><body><div><article>{PARTS}</article><div><p>Words beside it, a few of them.</p></div></div></body></html>"
    text = html_text.main_text(page)
    assert text.startswith("Part 0") and "Part 4" in text and "beside" not in text

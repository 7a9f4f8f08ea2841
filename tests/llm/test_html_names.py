import pytest

from evispark.llm import html_text

PROSE = "A sentence of the article that goes on for a while, with more than a few words in it. " * 6
TEXT = " ".join(PROSE.split())
BODY = f"<h1>Head line</h1><p>{PROSE}</p><p>{PROSE}</p>"
WHOLE = f"Head line\n{TEXT}\n{TEXT}"
FRAME = '<html><body><div class="nav"><a href="/a">menu</a> <a href="/b">two</a></div>{}<div id="footer">Imprint and more</div></body></html>'


@pytest.mark.parametrize(
    "page",
    [
        FRAME.format(f'<form id="aspnetForm"><div>{BODY}</div><div class="login">Sign in here</div></form>'),
        f'<html><body><form action="."><div>{BODY}</div><div class="footer">Imprint</div></form></body></html>',
        *[FRAME.format(f'<div class="{c}">{BODY}</div>') for c in ("content has-sidebar", "with-nav", "share-enabled", "row sidebar-layout", "comments-open")],
        *[FRAME.format(f'<article class="post {c}">{BODY}</article>') for c in ("category-social", "tag-search", "category-advertising", "comments-open")],
        FRAME.format(f'<div><div class="widget"><h1>Head line</h1></div><div class="widget"><p>{PROSE}</p></div><div class="widget"><p>{PROSE}</p></div></div>'),
    ],
)
def test_names_never_take_the_text_away(page):
    assert html_text.main_text(page) == WHOLE


@pytest.mark.parametrize(
    "part",
    [
        '<form><p>Your name and your mail, please.</p><input></form>',
        f'<div id="comments"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>',
        f'<div class="comment-list"><article class="comment-body"><p>{PROSE * 5}</p></article></div>',
        f'<section class="related"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></section>',
        '<div class="cookie-notice">We use cookies</div>',
    ],
)
def test_parts_beside_the_text_stay_out(part):
    assert html_text.main_text(FRAME.format(f"<article>{BODY}</article>{part}")) == WHOLE


def test_comments_around_divided_text():
    page = FRAME.format(f'<div class="page-sidebar">{BODY}<div id="comments"><p>{PROSE * 9}</p></div></div>')
    assert html_text.main_text(page) == WHOLE

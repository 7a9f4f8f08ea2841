"""Passages of an article whose class, tag or id sounds like something else."""

import pytest

from evispark.llm.html_text import main_text

LONG = "A sentence of the article that goes on for a while, so that it counts. " * 4
PAGE = "<html><body><nav><a href=1>Home</a></nav><article><h1>Head</h1><p>" + LONG + "</p>{}<p>" + LONG + "</p></article><footer>end</footer></body></html>"
KEPT = [
    ("<p class='related'>Related work is cited here.</p>", "Related work is cited here."), ("<p class='share'>The share fell.</p>", "The share fell."), ("<label>Price</label> <button>9</button>", "Price 9"),
    ("<p id='search'>The search went <a href=x>on</a> for days.</p>", "The search went on for days."), ("<div class='social'><p>Social life in towns.</p></div>", "Social life in towns."), ("<ul><li class='banner'>A banner was raised.</li></ul>", "A banner was raised."),
    ("<h2 class='login'>Login to the system</h2>", "Login to the system"), ("<td class='menu'>Soup</td>", "Soup"), ("<div class='widgets'>Widgets cost 3.</div>", "Widgets cost 3."),
]
CUT = [
    "<div class='related'><a href=1>Another article</a> <a href=2>One more</a></div>", "<div class='share'>Share: <a href=1>here we go</a></div>", "<div class='newsletter'>Get our letter <input type=email></div>", "<div class='ad'>Buy now</div>", "<p class='notice'>We use cookies</p>",
    "<div class='subscribe'><form>Join <label>Mail</label><button>Go</button></form></div>", "<div class='comments'><p>First!</p></div>", "<aside>Side</aside>", "<div role='search'>Find</div>", "<p class='advert'>Cheap</p>", "<form><label>Name</label><button>Send</button>x</form>",
]


@pytest.mark.parametrize("part, text", KEPT)
def test_kept(part, text):
    one = " ".join(LONG.split())
    assert main_text(PAGE.format(part)) == f"Head\n{one}\n{text}\n{one}"


@pytest.mark.parametrize("part", CUT)
def test_cut(part):
    one = " ".join(LONG.split())
    assert main_text(PAGE.format(part)) == f"Head\n{one}\n{one}"


def test_a_page_in_one_form():
    one = " ".join(LONG.split())
    assert main_text(f"<body><form><div><p>{LONG}</p><p>{LONG}</p><label>Mail</label><button>Go</button></div></form></body>") == f"{one}\n{one}"

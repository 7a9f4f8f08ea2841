"""The density step against a plain version of its own, and pages that only density can tell apart."""

import html.parser
import math
import random
import time

import pytest

from evispark.llm import html_text

WORDS = "the river runs past an old mill where nobody has ground any corn since the bridge fell in".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


class Tree(html.parser.HTMLParser):
    """Well-formed pages only: [tag, children], text as str."""

    def __init__(self, page):
        super().__init__()
        self.open = [["#", []]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][1].append(data)


def figures(node, link=False):
    """(characters, tags, link characters, link tags) of a node, counted anew at each call."""
    tag, children = node
    link = link or tag == "a"
    c = t = lc = lt = 0
    for x in children:
        if isinstance(x, str):
            n = len(" ".join(x.split()))
            c, lc = c + n, lc + n * link
        else:
            a = figures(x, link)
            c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3]
    return c, t, lc, (t + 1 if tag == "a" else lt)


def density(node, body):
    c, t, lc, lt = figures(node)
    if not c:
        return 0.0
    cb, _, lcb, _ = figures(body)
    one = lambda x: x or 1
    base = math.log(c * lc / one(c - lc) + lcb / one(cb) * c + math.e)
    value = c / one(lc) * one(t) / one(lt)
    return c / one(t) * (math.log(value, base) if abs(base - 1) > 1e-12 else math.log(value))


def all_nodes(node):
    yield node
    for c in node[1]:
        if not isinstance(c, str):
            yield from all_nodes(c)


def random_page(rng, depth=4):
    def part(level):
        kind = rng.choice(["p", "p", "div", "section", "ul"]) if level else "p"
        if kind == "p":
            links = "".join(f' <a href="/x">{prose(rng, 2)}</a>' for _ in range(rng.choice([0, 0, 1, 3])))
            return f"<p>{prose(rng, rng.choice([2, 10, 60]))}{links}</p>"
        if kind == "ul":
            return "<ul>" + "".join(f'<li><a href="/y">{prose(rng, 2)}</a></li>' for _ in range(rng.randrange(1, 6))) + "</ul>"
        return f"<{kind}>" + "".join(part(level - 1) for _ in range(rng.randrange(1, 5))) + f"</{kind}>"

    return "<html><body>" + "".join(part(depth) for _ in range(3)) + "</body></html>"


@pytest.mark.parametrize("seed", range(60))
def test_densities_and_root_equal_a_plain_version(seed):
    page = random_page(random.Random(seed))
    plain = next(n for n in all_nodes(Tree(page).open[0]) if n[0] == "body")
    nodes = html_text._walk(html_text.parse(page))
    body = next(n for n in nodes if n.tag == "body")
    html_text._measure(nodes, body)
    own, theirs = [n for n in nodes if n.tag not in ("#page", "html")], list(all_nodes(plain))
    assert [n.tag for n in own] == [n[0] for n in theirs]
    want = [density(n, plain) for n in theirs]
    assert [n.density for n in own] == pytest.approx(want, rel=1e-9, abs=1e-9)
    of = {id(n): w for n, w in zip(theirs, want, strict=True)}
    sums = [sum(of[id(c)] for c in n[1] if not isinstance(c, str)) for n in theirs]
    best = own.index(body.best)
    assert sums[best] == pytest.approx(max(sums))
    # the path threshold: whoever reaches it and is no child of a pick gives a pick; the root always is one
    assert id(body.best) in html_text._choose(body)


def test_density_alone_finds_the_text():
    """No article, no telling name: a menu, a link list and a teaser stay out, the divided text comes whole."""
    rng = random.Random(5)
    text = [prose(rng, 80) for _ in range(8)]
    menu = "<div>" + "".join(f'<span><a href="/{i}">{prose(rng, 2)}</a></span>' for i in range(30)) + "</div>"
    links = "<div><ul>" + "".join(f'<li><a href="/{i}">{prose(rng, 5)}</a></li>' for i in range(30)) + "</ul></div>"
    halves = ["<div>" + "".join(f"<p>{t}</p>" for t in text[a : a + 4]) + "</div>" for a in (0, 4)]
    page = f"<html><body>{menu}<div>{halves[0]}<p>Short one.</p>{halves[1]}</div>{links}</body></html>"
    assert html_text.main_text(page) == "\n".join([*text[:4], "Short one.", *text[4:]])


def test_names_do_not_choose():
    """A part with the article's look but little text is no rival; a dense part that is named comments isn't taken."""
    rng = random.Random(6)
    text, said = [prose(rng, 60) for _ in range(5)], [prose(rng, 90) for _ in range(9)]
    page = "<body><div>{}</div><div id='comments'>{}</div></body>".format(*("".join(f"<p>{t}</p>" for t in x) for x in (text, said)))
    assert html_text.main_text(page) == "\n".join(text)


@pytest.mark.parametrize(
    "hostile",
    [
        lambda n: "<a " * n, lambda n: '<a ="' * n, lambda n: '<a =">" ' * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<div>" * n + "x" + "</section>" * n,
        lambda n: "<div>" * n + "<header>x" * n, lambda n: "<article>" * n + "<p>text here</p>" * n, lambda n: "<ul><li>" * n + "<b>x" * n, lambda n: "<!--" * n, lambda n: "<span>" * n + "word" + "<td>" * n,
        lambda n: "<a " + " b   " * n + ">", lambda n: '<div class="ad">' * n + "some text", lambda n: "<table>" * n + "<tr><td>x" * n,
    ],
)
def test_time_grows_with_the_page(hostile):
    def seconds(n):
        best = 9e9
        for _ in range(2):
            began = time.process_time()
            html_text.main_text(hostile(n))
            best = min(best, time.process_time() - began)
        return best

    small, large = seconds(5_000), seconds(20_000)
    assert large < 12 * small + 0.5  # four times the page; quadratic work would take sixteen times as long


def test_rows(spark):
    """Clashing and extra columns, repeated rows, null ids, texts and urls, a long page; an empty table."""
    long = "<article>" + "<p>Words of a page that goes on and on.</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<p>one</p>", "x", 1), (1, "u", "<p>one</p>", "x", 2), (None, None, "<p>two</p>", None, 3), (4, "v", None, "y", 4), (5, "w", "", "y", 5), (6, "w", long, "y", 6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id or 0, r.url, r.text[:20], r.n_chars) for r in html_text.extract(frame).collect()), key=repr)
    line = "Words of a page that goes on and on."
    want = [(1, "u", "one", 3), (1, "u", "one", 3), (0, None, "two", 3), (4, "v", "", 0), (5, "w", "", 0), (6, "w", line[:20], 20_000 * len(line) + 19_999)]
    assert got == sorted(want, key=repr)
    assert html_text.extract(frame.limit(0)).collect() == []

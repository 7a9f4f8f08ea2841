"""Guides and contexts against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.operators import context as cx
from evispark.operators import guides as gd

HEAD = "---\ntitle: T\nlang: es\nsources: x: y\n---\n"


def chunked(spark, *texts):
    rows = gd.guide_chunks(spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "id int, text string, title string"), "id", "text").collect()
    return sorted(rows, key=lambda r: (r.id, r.pos or 0))


@pytest.mark.parametrize(
    "text, problem",
    [
        (None, "no front matter"), ("", "no front matter"), ("# T\ntext", "no front matter"), ("---\ntitle: a\ntitle: b\n---\nx", "a key stands twice"), ("---\ntitle: a\nlang:\n---\nx", "lacks lang, sources"),
        ("---\ntitle: a\nlang: fr\nsources: s\n---\nx", "unknown language"), (HEAD, "no text"), (HEAD + "## only\n### headings\n<!-- questions: a -->\n \n", "no text"),
        (HEAD.replace("\n---\n", "\nregion: Spain\n---\n"), "region is no country code"), (HEAD.replace("\n---\n", "\nverified: 2024-02-30\n---\n"), "verified is no date"), (HEAD.replace("\n---\n", "\nid: Big One\n---\nx"), "id has other signs than small letters, digits and dashes"),
    ],
)
def test_problems(spark, text, problem):
    [row] = chunked(spark, text)
    assert row.problem == problem and row.body is None and row.pos is None


def test_sections_paths_and_questions(spark):
    body = "Intro line.\r\n## Before\n- one\n### Water\n<!-- Preguntas: how much? | where? -->\n" + "- two " * 60 + "\n# After\n#not a heading\n##  \nnameless"
    rows = chunked(spark, HEAD.replace("\n---\n", "\nquestions: whole?\n---\n", 1) + body)
    assert rows[0].body.startswith("Intro line.\n\nBefore\n- one") and rows[0].questions[0] == "whole?" and rows[0].title == "T" and rows[0].lang == "es"
    assert sum(r.body.count("two") for r in rows) == 60 and any("#not a heading" in r.body for r in rows)


def plain_chunks(body, target, short):
    """The same from the rules, piece by piece on whole strings."""
    parts, path, buffer = [], [], []
    for line in body.split("\n") + ["# end"]:
        level = len(line) - len(line.lstrip("#"))
        if 1 <= level <= 6 and line[level : level + 1].isspace():
            if "\n".join(buffer).strip():
                parts.append(([n for _, n in path], "\n".join(buffer).strip()))
            path = [p for p in path if p[0] < level] + [(level, line[level:].strip())]
            buffer = []
        else:
            buffer.append(line)
    pieces = []
    for p, text in parts:
        lines, start = text.split("\n"), 0
        while start < len(lines):
            if not lines[start]:  # a piece doesn't begin with an empty line
                start += 1
                continue
            end = start + 1
            while end < len(lines) and len("\n".join(lines[start : end + 1])) <= target:
                end += 1
            if "\n".join(lines[start:end]).strip():
                pieces.append([p, ((p[-1] + "\n" if p else "") + "\n".join(lines[start:end])).strip()])
            start = end
    out = []
    for p, text in pieces:
        if out and out[-1][0] != p and len(text) < short and len(out[-1][1] + "\n\n" + text) <= target:
            out[-1][1] += "\n\n" + text
        else:
            out.append([p, text])
    if len(out) > 1 and len(out[0][1]) < short and len(out[0][1] + "\n\n" + out[1][1]) <= target:
        out[:2] = [[out[1][0], out[0][1] + "\n\n" + out[1][1]]]
    return [(p, t) for p, t in out]


@pytest.mark.parametrize("seed", range(5))
def test_chunks_equal_a_plain_version(spark, seed):
    rng = random.Random(seed)
    lines = ["", " ", "x", "- item", "words " * 4, "long " * 30, "# A", "## B", "### C d", "#### ", "#x", "####### seven", "é" * 50]
    bodies = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for body in bodies:
        assert [(p, t) for p, t, _ in gd.chunks_of(body, "", 120, 40)] == plain_chunks(body, 120, 40)
    rows = chunked(spark, *[HEAD + b for b in bodies])
    for i, body in enumerate(bodies):
        assert [(r.path, r.body) for r in rows if r.id == i and not r.problem] == plain_chunks(body, gd.TARGET, gd.SHORT)
        assert any(r.id == i and r.problem for r in rows) == (not plain_chunks(body, gd.TARGET, gd.SHORT))


def plain_fit(bodies, budget, chars, frame, least_chars, least_share):
    """Drop from the end; else cut the first by trying every end; else drop the first."""
    cost = lambda b: frame + -(-len(b) // chars)
    left = list(enumerate(bodies, 1))
    while left:
        for n in range(len(left), 0, -1):
            if sum(cost(b) for _, b in left[:n]) <= budget:
                return [(i, b, False) for i, b in left[:n]]
        rank, body = left[0]
        best = ""
        for k in range(1, len(body)):
            start = body[:k].rstrip()
            ends = body[k].isspace() and start[-1:] != "" and start.rstrip("\"»”')]")[-1:] in tuple(".!?…") and not body[k - 1].isspace()
            if (ends or body[k] == "\n") and start and cost(start) <= budget and k <= (budget - frame) * chars:
                best = max(best, start, key=len)
        if best and (len(best) >= least_chars or len(best) >= least_share * len(body)):
            return [(rank, best, True)]
        left = left[1:]
    return []


def test_fitting_equals_a_plain_version(spark):
    rng = random.Random(4)
    parts = ["Word. ", "word ", "He said 'no!' ", "line\n", "end?\n\n", "x" * 30, "… "]
    lists = {q: ["".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 10, 40]))) for _ in range(rng.randint(1, 6))] for q in range(80)}
    budgets = {q: rng.choice([0, 5, 15, 30, 60, 120, 400]) for q in lists}
    rows = [(q, i, b if b or rng.random() < 0.5 else None, budgets[q]) for q, bodies in lists.items() for i, b in enumerate(bodies, 1)]
    frame = spark.createDataFrame(rows, "q int, rank int, body string, budget int")
    got = {}
    for r in cx.fit_context(frame, F.col("budget"), chars=3, frame=4, least_chars=20, least_share=0.25).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.rank, r.body, r.truncated))
        assert r.tokens == 4 + -(-len(r.body) // 3)
    for q, bodies in lists.items():
        assert got.get(q, []) == plain_fit(bodies, budgets[q], 3, 4, 20, 0.25), (q, bodies, budgets[q])
    assert any(t for rows in got.values() for _, _, t in rows)

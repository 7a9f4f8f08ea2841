import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evispark.llm import html_text, language, neighbours, toxicity

SF = "/root/testdata/sf0.01"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side words here</aside><!-- hidden -->
<article>{body}</article>
<section id="comments"><p>First! What a fine reader comment this is, with many words in it, said a reader.</p></section>
<form><input value="x">Sign in</form><footer>&copy; site</footer></body></html>"""


def test_article_only():
    body = "<h1>Title &amp; more</h1><p>First  paragraph\nwith <b>bold</b> words &eacute; and <a href='x'>a link</a> in it.<p>Second one<br>goes on.<div class='ad'>Buy now</div><ul><li>item one<li>item two</ul>"
    assert html_text.main_text(PAGE.format(body=body)) == "Title & more\nFirst paragraph with bold words é and a link in it.\nSecond one goes on.\nitem one\nitem two"


def test_no_article_element():
    text = "Long prose without end, " * 20
    page = f"<html><body><div id='menu'><a href=1>x</a></div><div><div><p>{text}</p><p>{text}</p></div></div><div class='footer'>end</div></body></html>"
    assert html_text.main_text(page) == "\n".join([" ".join(text.split())] * 2)


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>x", "<body><nav>only menu</nav></body>"])
def test_empty_pages(page):
    assert html_text.main_text(page) == ""


def test_broken_markup_and_plain_text():
    assert html_text.main_text("just text & more") == "just text & more"
    assert html_text.main_text("<article><p>never <b>closed") == "never closed"
    assert html_text.main_text("<article><p>" + "<b>" * 3000 + "deep</article>") == "deep"


def test_pages_table(spark):
    rows = html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert all(r.text and r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text for r in rows)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    assert model.thresholds[0] <= model.thresholds[1]
    rows = toxicity.grade(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert np.mean([r.toxic for r in rows if r.label]) > 0.9 and np.mean([r.toxic for r in rows if not r.label]) < 0.03
    assert all(0 <= r.expected_severity <= 2 and r.grade in (0, 1, 2) and r.toxic == (r.grade > 0) for r in rows)


def test_toxicity_edges(spark):
    rows = [(i, f"vile rot number{i}", "k") for i in range(0, 60, 2)] + [(i, f"good day number{i}", "k") for i in range(1, 60, 2)] + [(101, None, "k"), (102, "", "k"), (103, "vile day", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(50)] + [(None, 1), (999, 0), (1, 0), (3, None)], "doc_id long, toxic int")
    left = toxicity.drop_toxic(docs, toxicity.train(docs, labels))
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and {101, 102, *range(1, 60, 2)} <= ids and not ids & set(range(0, 60, 2))
    assert toxicity.drop_toxic(docs, toxicity.train(docs, labels.where("toxic = 0"))).count() == docs.count()
    assert toxicity.grade(docs.limit(0), toxicity.train(docs, labels)).collect() == []


def brute_viterbi(scores, penalty):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda i: best[i])
        back.append([k if best[k] >= best[top] - penalty else top for k in range(len(best))])
        best = [max(best[k], best[top] - penalty) + row[k] for k in range(len(best))]
    path = [int(np.argmax(best))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_viterbi_equals_one_text_at_a_time():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 60)
    scores = rng.normal(size=(counts.sum(), 3)) * 3
    got = language.viterbi(scores, counts, 2.0)
    ends = np.cumsum(counts)
    for n, end in zip(counts, ends, strict=True):
        if n:
            assert got[end - n : end].tolist() == brute_viterbi(scores[end - n : end], 2.0)


def test_language_held_out_and_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(docs, ~held)
    rows = language.identify(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    texts = {r.lang: r.text for r in docs.where("n_chars BETWEEN 400 AND 1500").select("lang", "text").collect()}
    first, second = sorted(texts)[:2]
    mixed = [(1, texts[first] + " " + texts[second]), (2, None), (3, "123 !!! 45"), (4, ""), (5, "÷ × 7")]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert {s.lang for s in found[1].spans} >= {first, second}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and not found[i].spans for i in (2, 3, 4, 5))


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert [r.lang_pred for r in language.identify(docs, model).collect()] == ["und"]


def test_hilbert_curve_is_connected():
    bits = 3
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = neighbours.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in r], "k") for i, r in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 20 == 0).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    s = x.astype(float) @ x.T.astype(float)
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(score - s[q, v]) < 1e-9 for _, v, score in rows) and all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False))
        order = [v for v in np.argsort(-s[q]) if v != q][:20]
        hits += len({r[1] for r in rows} & set(order))
    assert len(found) == 75 and hits / (75 * 20) >= 0.9


def test_neighbours_edges(spark):
    same = [(i, [1.0, 0.0]) for i in range(30)]
    odd = [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (None, [1.0, 1.0]), (180, [1.0])]
    docs = spark.createDataFrame(same + odd + [(40, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(docs, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert set(got) == {0, 20, 40}
    assert [got[0][k] for k in range(1, 21)] == list(range(1, 21))
    assert [got[20][k] for k in range(1, 21)] == list(range(20))
    assert [got[40][k] for k in range(1, 21)] == list(range(20))
    assert neighbours.nearest(docs.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_slices_cover_all_rows():
    from evispark.llm import bytewords

    rng = random.Random(1)
    column = pa.array([None if rng.random() < 0.1 else "x " * rng.randrange(50) for _ in range(200)])
    parts = list(bytewords.slices(column, 100))
    assert parts[0][0] == 0 and parts[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))

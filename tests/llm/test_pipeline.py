"""The corpus pipeline on a small fixture: all stages, each held against what it must decide, with odd rows and columns."""

import random

import pytest

import corpus_pipeline
from evispark.llm import near_dup, queries, toxicity

WORDS = [f"word{i}" for i in range(3000)]
VILE = [f"vile{i}" for i in range(12)]


def prose(rng, n, extra=()):
    words = [rng.choice(WORDS) for _ in range(n)]
    for w in extra:
        words[rng.randrange(n)] = w
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(11)
    clean = [(i, prose(rng, 70)) for i in range(80)]
    toxic = [(i, prose(rng, 70, rng.sample(VILE, 8))) for i in range(100, 150)]
    item = " ".join(rng.choice(WORDS) for _ in range(25))
    words = clean[3][1].split()
    rows = [*clean, *toxic, (200, clean[3][1] + "x"), (201, clean[4][1]), (202, prose(rng, 40) + "\n" + item + "\n" + prose(rng, 40)), (203, clean[5][1].split("\n")[0] + "\n" + prose(rng, 60)), (204, None), (205, ""), (None, prose(rng, 30)), (206, " ".join(words[:69]) + " other")]
    folder = tmp_path_factory.mktemp("sf")
    columns = "doc_id long, text string, lang string, source string, n_chars long, gone string, toxic int, links int, band string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "g", 1, 2, "b") for i, t in rows] + [(7, clean[7][1], "en", "s", 1, "g", 1, 2, "b")], columns)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean[:60]] + [(i, 0, 1) for i, _ in toxic[:35]] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {i: t for i, t in rows}


def test_all_stages(spark, fixture):
    folder, texts = fixture
    docs = queries.table(spark, folder, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, folder), f"test-{name}")
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != "sentencepiece":
            assert docs.columns == before.columns
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    clean = set(range(80))
    assert not set(ids["toxicity"]) & set(range(100, 150)) and clean <= set(ids["toxicity"])
    assert {204, 205, None} <= set(ids["toxicity"])
    # lines: exact copies of documents lose all their lines and go; a repeated line goes, the rest stays
    assert 201 not in ids["line_dedup"] and 203 in ids["line_dedup"]
    by_id = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert texts[5].split("\n")[0] not in by_id[203] and by_id[5] == texts[5]
    assert {204, 205, None} <= set(ids["line_dedup"])
    assert clean <= set(ids["near_duplicates"])
    groups = near_dup.near_duplicates(spark.createDataFrame(kept["line_dedup"], corpus_pipeline.table(spark, folder, "documents").schema)).where("kept").collect()
    assert sorted(map(str, ids["near_duplicates"])) == sorted(str(r.doc_id) for r in groups)
    assert 202 in ids["near_duplicates"] and 202 not in ids["decontamination"] and clean <= set(ids["decontamination"])
    last = {r["doc_id"]: r for r in kept["sentencepiece"]}
    assert sorted(map(str, ids["sentencepiece"])) == sorted(map(str, ids["decontamination"]))
    assert all(r["parity"] and r["round_trip"] for r in kept["sentencepiece"]) and last[9]["decoded"] == texts[9] and last[204]["n_tokens"] == 0


def test_registered_query_and_empty_tables(spark, fixture, tmp_path):
    folder, _ = fixture
    got = queries.pipeline(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "parity", "round_trip", "ids", "decoded"] and got.count() > 80
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_fit_reaches_a_plain_optimum(spark, fixture):
    """The fitted model's loss on its own features is close to that of a long plain gradient descent."""
    import numpy as np
    import pyarrow as pa

    _, texts = fixture
    ids = [*range(60), *range(100, 135)]
    toxic = np.array([i >= 100 for i in ids]).astype(int)
    row, place, value = toxicity.features(pa.array([texts[i] for i in ids]))
    model = toxicity.fit(row, place, value, toxic)
    line = np.bincount(row, weights=model.weights[place] * value, minlength=len(ids))
    p = 1 / (1 + np.exp(np.clip(model.thresholds[0] - line, -40, 40)))
    assert ((p >= 0.5) == (toxic == 1)).all()
    used, column = np.unique(place, return_inverse=True)
    x = np.zeros((len(ids), len(used)))
    x[row, column] = value
    x -= x.mean(0)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(3000):
        g = 1 / (1 + np.exp(-(x @ w + b))) - toxic
        w, b = w - 0.002 * x.T @ g, b - 0.002 * g.sum()
    plain = 1 / (1 + np.exp(-(x @ w + b)))
    assert ((plain >= 0.5) == (p >= 0.5)).all()

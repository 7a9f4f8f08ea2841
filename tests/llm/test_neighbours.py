"""Vector search against all inner products: recall on the tables, ties, blocks, rows that clash or repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import neighbours


def exact(ids, x, k=20):
    """{query: [(score, id)]} of the k nearest, ties to smaller ids."""
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = np.lexsort((ids, -s))
        out[int(ids[q])] = [(s[i], int(ids[i])) for i in order if ids[i] != ids[q]][:k]
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    table = frame.toArrow()
    want = exact(table.column("vec_id").to_numpy(), np.stack(table.column("embedding").to_pylist()).astype(float))
    got = lists(neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect())
    hits = sum(len({v for _, v in got[q]} & {v for _, v in rows}) for q, rows in want.items())
    assert set(got) == set(want) and hits >= 0.92 * sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ties_go_to_smaller_ids(spark, kind):
    """With windows over everything the lists are exact, on vectors of few values where most scores are equal."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (700, 6)).astype(float)
    x[(x == 0).all(1)] = 1
    ids = rng.permutation(700)
    frame = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>")
    got = lists(neighbours.nearest(frame, F.col("vec_id") % 20 == 0, curves=2, window=2.0).collect())
    assert got == exact(ids, x)


def test_places_of_equal_keys_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(5)
    x = np.concatenate([1 + 1e-7 * rng.normal(size=(300, 4)), 5 * rng.normal(size=(60, 4))])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = lists(neighbours.nearest(frame, F.col("vec_id") % 20 == 0, window=2.0).collect())
    want = exact(np.arange(360), x)
    assert {q: [v for _, v in rows] for q, rows in got.items()} == {q: [v for _, v in rows] for q, rows in want.items()}


def test_best_of():
    s = np.array([[3.0, 5.0, 5.0, 5.0, 1.0], [2.0, 2.0, 2.0, 2.0, 2.0]])
    assert neighbours.best_of(s, 2).tolist() == [[False, True, True, False, False], [True, True, False, False, False]]
    assert neighbours.best_of(s, 9).all()


def test_clashing_columns_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, q long, cls long, rank int, place int, score double, asks boolean, keys array<long>"
    rows = [(i % 25, [float(i % 5), 1.0], 1, 1, 1, 1, 1.0, True, [1]) for i in range(100)]
    got = lists(neighbours.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).collect())
    assert set(got) == {0, 20} and all(len(r) == 20 for r in got.values())
    assert all(v != q for q, r in got.items() for _, v in r)


@pytest.mark.parametrize("scale", [1e-8, 3e-7, 1e8])
def test_recall_does_not_depend_on_length(spark, scale):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    scaled = frame.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * scale).alias("embedding"))
    table = scaled.toArrow()
    want = exact(table.column("vec_id").to_numpy(), np.stack(table.column("embedding").to_pylist()).astype(float))
    got = lists(neighbours.nearest(scaled, F.col("vec_id") % 20 == 0).collect())
    hits = sum(len({v for _, v in got[q]} & {v for _, v in rows}) for q, rows in want.items())
    assert hits >= 0.92 * sum(map(len, want.values()))


@pytest.mark.parametrize("scale", [2.0**-27, 2.0**27])  # exact, so that equal scores stay equal
def test_ties_of_scaled_vectors(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (300, 6)).astype(float)
    x[(x == 0).all(1)] = 1
    frame = spark.createDataFrame([(i, [float(v) * scale for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = lists(neighbours.nearest(frame, F.col("vec_id") % 20 == 0, curves=2, window=2.0).collect())
    want = exact(np.arange(300), x * scale)
    assert {q: [v for _, v in r] for q, r in got.items()} == {q: [v for _, v in r] for q, r in want.items()}


def test_best_of_is_relative():
    s = np.array([[3.0, 5.0, 5.0, 4.0], [0.0, 0.0, 0.0, 0.0], [-1.0, -3.0, -2.0, -1.0]])
    for scale in (1e-20, 1.0, 1e20):
        assert neighbours.best_of(s * scale, 2).tolist() == [[False, True, True, False], [True, True, False, False], [True, False, False, True]]

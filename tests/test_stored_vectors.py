"""Search over stored float and int8 rows against numpy, and the bytes' functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.functions import vectors as vx
from evispark.operators import similarity as sm

WIDTH = 24


def codes_of(x):
    step = np.abs(x).max() / 127 or 1.0
    return np.clip(np.floor(x / step + 0.5), -127, 127).astype(np.int8), step


def table_of(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows, known = [], {}
    for i in range(n):
        x = rng.normal(size=WIDTH).astype("<f4") * np.float32(10.0 ** rng.integers(-3, 3))
        codes, step = codes_of(x.astype(float))
        if i % 4 == 0:
            rows.append((i, x.tobytes(), None))
            known[i] = x.astype(float)
        elif i % 4 == 1:
            rows.append((i, codes.tobytes(), float(step)))
            known[i] = codes * float(step)
        else:
            rows.append((i, [None, b"", x.tobytes()[:-1], codes.tobytes() + b"x"][i % 8 // 2 if i % 4 == 2 else 3], 1.0))
    rows += [(n, np.zeros(WIDTH, "<f4").tobytes(), None), (n + 1, np.full(WIDTH, np.nan, "<f4").tobytes(), None), (None, rows[0][1], None)]
    known[n] = np.zeros(WIDTH)
    return spark.createDataFrame(rows, "doc long, blob binary, step double").repartition(3), known


@pytest.mark.parametrize("unit", [True, False])
@pytest.mark.parametrize("k, least", [(5, None), (None, 0.2), (5, 0.2)])
def test_equals_the_dequantised_product(spark, unit, k, least):
    stored, known = table_of(spark, 120, 1)
    queries = stored.where("doc % 3 = 0").select(F.col("doc").alias("q"), F.col("blob").alias("asked"), "step")
    got = sm.similar_stored(stored, queries, WIDTH, k=k, least=least, unit=unit).collect()
    want = []
    for q in (i for i in known if i % 3 == 0):
        length = lambda x: (np.linalg.norm(x) or 1.0) if unit else 1.0
        found = [(round(float(known[q] @ x / length(known[q]) / length(x)), 6), d) for d, x in known.items() if d != q]
        found = sorted(((-s, d) for s, d in found if least is None or s >= least))[:k]
        want += [(q, d, -s) for s, d in found]
    assert sorted((r.q, r.doc) for r in got) == sorted((q, d) for q, d, _ in want)
    assert {(r.q, r.doc): r.score for r in got} == {(q, d): pytest.approx(s, abs=2e-6) for q, d, s in want}


def test_products_of_codes_are_whole_numbers():
    a, b = (np.random.default_rng(s).integers(-127, 128, (40, 1024), np.int8) for s in (1, 2))
    assert (sm._dot(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    wide = np.full((1, 4096), 127, np.int8)
    assert sm._dot(wide, wide)[0, 0] == 4096 * 127 * 127


def test_kinds_and_migration(spark):
    stored, known = table_of(spark, 40, 2)
    kinds = {r.kind: r.n for r in sm.stored_kinds(stored, WIDTH).collect()}
    assert kinds == {"float": 13, "int8": 10, "broken": 20}
    once = sm.migrated(stored.where("doc IS NOT NULL"), WIDTH)
    rows = {r.doc: r for r in once.collect()}
    for i, x in known.items():
        codes, step = codes_of(x)
        if i % 4 == 0:
            assert rows[i].blob == codes.tobytes() and rows[i].step == pytest.approx(step)
    assert {r.doc: (r.blob, r.step) for r in sm.migrated(once, WIDTH).collect()} == {i: (r.blob, r.step) for i, r in rows.items()}
    assert [r.doc for r in once.where(sm.kind_of(F.col("blob"), WIDTH) == "float").collect()] == [41]  # not a number


def test_bytes_and_back(spark):
    rows = [(0, [1.5, -2.0]), (1, None), (2, [None, 1.0]), (3, []), (4, [0.0, 0.25])]
    blobs = spark.createDataFrame(rows, "id int, v array<float>").coalesce(1).select("id", vx.as_blob(F.col("v"), "float").alias("b"))
    assert {r.id: r.b for r in blobs.collect()} == {0: np.array([1.5, -2], "<f4").tobytes(), 1: None, 2: None, 3: b"", 4: np.array([0, 0.25], "<f4").tobytes()}
    assert {r.id: r.v for r in blobs.select("id", vx.from_blob(F.col("b"), 2, F.lit(1.0)).alias("v")).collect()} == {0: [1.5, -2.0], 1: None, 2: None, 3: None, 4: [0.0, 0.25]}


def test_no_rows(spark):
    stored, _ = table_of(spark, 8, 3)
    queries = stored.select(F.col("doc").alias("q"), F.col("blob").alias("asked"), "step")
    assert sm.similar_stored(stored.limit(0), queries, WIDTH, k=3).collect() == []
    assert sm.similar_stored(stored, queries.limit(0), WIDTH, k=3).collect() == []

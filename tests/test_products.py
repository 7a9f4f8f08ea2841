"""Vector search in slices: what a task holds and passes on, and that nothing is lost by it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from evispark.operators import ranking as rk
from evispark.operators import similarity as sm


def test_a_pair_of_full_blocks_needs_bounded_memory():
    rng = np.random.default_rng(3)
    q, d = rng.normal(size=(sm.BLOCK_QUERIES, 16)), rng.normal(size=(sm.BLOCK_VECTORS, 16))
    sides = [sm._block(np.arange(len(x)) + at, "f8", x.astype("<f8"), np.ones(len(x))) for x, at in ((q, 0), (d, 1 << 20))]
    pair = pa.RecordBatch.from_arrays([c for side in sides for c in side.columns], [f"{s}{c}" for s in "qd" for c in ("ids", "kind", "rows", "scale")])
    tracemalloc.start()
    rows = sum(b.num_rows for b in sm._product(50, None, None)(iter([pair])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 50 * len(q)
    assert peak < 250 << 20


def test_background_floor_of_few_rows_equals_that_of_all(spark):
    rng = np.random.default_rng(4)
    close = rng.normal(size=(6, 8))
    data = [(i, [float(x) for x in np.round(close[i % 6] + rng.normal(size=8) * (0.2 if i % 9 else 3), 1)]) for i in range(1500)]
    data += [(2000, None), (2001, [0.0] * 8)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for n in (1502, 40):
            vectors = spark.createDataFrame(data[:n], "doc long, embedding array<double>").repartition(3)
            asked = vectors.where("doc % 50 = 0").selectExpr("doc AS q", "embedding AS asked")
            for floor, gap in ((0.1, 0.05), (0.6, 0.3), (0.1, 0.0)):
                everything, fewer = sm.similar(vectors, asked), sm.similar(vectors, asked, apart=rk.background(floor, gap))
                found = [sorted(map(tuple, rk.distinct_floor(x, floor, gap).collect())) for x in (everything, fewer)]
                assert found[0] == found[1]
            best = [sorted(map(tuple, x.collect())) for x in (rk.top_k(everything, 7), sm.similar(vectors, asked, k=7))]
            assert best[0] == best[1]
        strict = sm.similar(spark.createDataFrame(data, "doc long, embedding array<double>").coalesce(1), asked, apart=(11, 50, 0.1, 0.9))
        assert strict.count() < sm.similar(spark.createDataFrame(data, "doc long, embedding array<double>"), asked).count() / 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

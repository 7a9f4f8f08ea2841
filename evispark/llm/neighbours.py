"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Equal vectors are one class (its smallest ids stand for it, as many as an answer can hold). Each of CURVES
curves projects the vectors on a few random directions, shifts them and orders them by their Hilbert key; the
order is cut into ranges of equal size. A query visits, on every curve, its own range and its neighbours, WINDOW of all
rows in all; Spark brings a range's rows and its visitors together in blocks of bounded size, numpy takes each block's
best, and the best of all curves are ranked again in double precision on the original vectors. Where a block's best
are cut off, equal scores go to smaller ids. Many narrow windows find more than few wide ones at the same cost: on
vectors without clusters (64 dimensions) 16 curves of 10 % find 0.95 of the neighbours, 6 of 24 % find 0.90.

Vectors that are null, zero, not of the most frequent length, or that hold nulls or non-finite components take
no part. Fewer rows than asked for give all. Repeated ids give the rows they have; ties go to smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.tables import written

CURVES, WINDOW = 16, 0.1
#: Projected dimensions, bits for each, rows that centre and range are fitted on (at most), ranges of a curve (at least).
DIMENSIONS, BITS, SAMPLE, RANGES = 4, 8, 4096, 30
#: Rows of a range and queries of a block, at most about; rows that a block returns beyond those asked for.
RANGE_ROWS, BLOCK_QUERIES, SLACK = 1 << 14, 4096, 4


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of each row of cell numbers below 2**bits (bits times columns <= 62).

    Goes from the coarsest bit to the finest: cells are mirrored or exchanged so that each sub-cube is
    entered in the orientation that keeps the curve connected; then the Gray code is undone.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for axis in range(len(x)):
            upper = (x[axis] & high) > 0
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(upper, low, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = (key << 1) | ((x[axis] >> bit) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_curves(sample: np.ndarray, curves: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(directions, lowest projection with its shift, cell size) of each curve."""
    out = []
    for k in range(curves):
        rng = np.random.default_rng(1000 + k)
        axes = np.linalg.qr(rng.normal(size=(sample.shape[1], min(DIMENSIONS, sample.shape[1]))))[0]
        y = sample @ axes
        low, high = y.min(0), y.max(0)
        width = np.where(high > low, high - low, 1.0) * 1.25
        out.append((axes, low - width * rng.uniform(0, 0.2, len(low)), width / (1 << BITS)))
    return out


def _keys(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, keys = _matrix(batch.column(1)), []
            for axes, low, size in shared.value:
                keys.append(hilbert_keys(np.clip((x @ axes - low) / size, 0, (1 << BITS) - 1).astype(np.int64), BITS))
            flat = np.stack(keys, 1).reshape(-1)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["cls", "embedding", "keys"])

    return run


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Marks the k greatest of each row; of equal ones the first."""
    # sums in another order differ by less than this share of the greatest score
    scale = np.abs(scores).max(1, keepdims=True, initial=0.0)
    scores = np.round(scores / np.where(scale > 0, scale, 1.0), 12)
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    bar = np.partition(scores, -k, axis=1)[:, -k, None]
    above, level = scores > bar, scores == bar
    room = k - above.sum(1, keepdims=True)
    return above | (level & (np.cumsum(level, axis=1) <= room))


def _best(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        rows = rows.sort_values("cls")
        x, ids, own = np.stack(rows["embedding"]).astype(np.float64), rows["cls"].to_numpy(), queries["q"].to_numpy()
        parts = []
        for a in range(0, len(queries), 256):
            s = np.stack(queries["embedding"].iloc[a : a + 256]).astype(np.float64) @ x.T
            i, j = np.nonzero(best_of(s, k))
            parts.append(pd.DataFrame({"q": own[a + i], "cls": ids[j], "score": s[i, j]}))
        return pd.concat(parts)

    return run


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row that ``is_query`` (a Column)."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats are sent as they are and multiplied as doubles
    named = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("embedding"), is_query.alias("asks"))
    sound = F.size("embedding") > 0
    sound &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = named.where(sound)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("embedding") == sizes[0].d)
    # of equal vectors an answer holds k at most, besides the query's own row
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("id"))
    firsts = rows.select("id", "embedding").withColumn("rank", rank).where(F.col("rank") <= k + 1)
    classes = written(firsts.groupBy("embedding").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n = classes.count()
    asked = rows.where(F.col("asks")).select(F.col("id").alias("query_id"), "embedding")
    asking = asked.groupBy("embedding").agg(F.min("query_id").alias("q"))
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    shared = spark.sparkContext.broadcast(fit_curves(_matrix(sample), curves))
    keyed = written(classes.select("cls", "embedding").mapInArrow(_keys(shared), f"cls long, embedding {kind}, keys array<long>"), "keys")
    ranges = min(max(RANGES, -(-n // RANGE_ROWS)), max(1, n // 8))
    reach = max(1, int(window * ranges / 2)) if ranges > 1 else 0
    shares = [i / ranges for i in range(1, ranges)]
    cuts = keyed.agg(*[F.percentile_approx(F.col("keys")[c], shares, 20_000).alias(str(c)) for c in range(curves)]).first() if shares else [[]] * curves
    # a key's range: the number of cuts at or below it
    limits = spark.sparkContext.broadcast([np.array(sorted(set(c)), np.int64) for c in cuts])

    def placed(frame: DataFrame, ids: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                keys = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                at = np.stack([np.searchsorted(limits.value[c], keys[:, c], side="right") for c in range(keys.shape[1])], 1) if batch.num_rows else keys
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * curves
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.reshape(-1).astype(np.int32)))], [ids, "embedding", "places"])

        return frame.select(ids, "embedding", "keys").mapInArrow(run, f"{ids} long, embedding {kind}, places array<int>").select(ids, "embedding", F.posexplode("places").alias("curve", "place"))

    queries = written(asking.join(keyed, "embedding"), "queries")
    # queries that visit a place come in blocks, and so do the rows of a place whose equal keys no cut can part
    blocks = max(1, -(-queries.count() * (2 * reach + 1) // (ranges * BLOCK_QUERIES)))
    stock = written(placed(keyed, "cls"), "places")
    sizes = stock.groupBy("curve", "place").agg(F.ceil(F.count("*") / (2 * RANGE_ROWS)).cast("int").alias("parts"))  # curves times ranges rows
    near = F.sequence(F.col("place") - reach, F.col("place") + reach)
    visits = placed(queries, "q").select("q", "embedding", "curve", F.explode(near).alias("place"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"))
    visits = visits.join(F.broadcast(sizes), ["curve", "place"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    stock = stock.join(F.broadcast(sizes), ["curve", "place"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts")
    stock = stock.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["curve", "place", "part", "block"]
    best = visits.groupBy(*keys).cogroup(stock.groupBy(*keys)).applyInPandas(_best(k + SLACK), "q long, cls long, score double")
    found = best.groupBy("q", "cls").agg(F.max("score").alias("score"))
    of_query = Window.partitionBy("q")
    level = F.round(F.col("score") / F.nullif(F.max(F.abs("score")).over(of_query), F.lit(0.0)), 12)
    kept = found.withColumn("level", F.coalesce(level, F.lit(0.0)))
    kept = kept.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("level"), "cls")))
    kept = kept.where(F.col("rank") <= k + SLACK).select("q", "cls")
    pairs = kept.join(classes.select("cls", F.col("embedding").alias("other"), "ids"), "cls").join(queries.select("q", "embedding"), "q")
    exact = F.aggregate(F.zip_with("embedding", "other", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("q", "ids", exact.alias("score"))
    asked = asked.join(queries.select("q", "embedding"), "embedding").select("query_id", "q")
    out = asked.join(scored, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return out.withColumn("rank", final).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

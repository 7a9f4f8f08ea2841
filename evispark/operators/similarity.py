"""Exact vector search: a stated set of queries against all vectors, multiplied in blocks.

Queries are packed into blocks of BLOCK_QUERIES rows, vectors into blocks of one Arrow batch each. Every pair of blocks
is one row of an equi-join on the query block (whose side is broadcast only if its bytes allow it) and is multiplied in
slices of SLICE scores. A task remembers each query's k-th best score so far and passes on what reaches it, so that only
about k rows for each query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.vectors import as_blob, blob_rows, from_blob, quantise, quantise_scale
from evispark.operators.ranking import top_k
from evispark.operators.sizes import BROADCAST_BYTES, bound_batches

#: Queries of a block, and vectors of a block at most.
BLOCK_QUERIES, BLOCK_VECTORS = 2048, 8192
#: Scores that are held at once (some ten arrays of their size).
SLICE = 1 << 20


def _matrix(column: pa.Array, unit: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    if not unit:
        return out
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(length > 0, length, 1.0)  # a zero vector has a similarity of 0 to all


_BLOCK = "ids binary, kind string, rows binary, scale binary"


def _block(ids: np.ndarray, kind: str, rows: np.ndarray, scale: np.ndarray) -> pa.RecordBatch:
    parts = [ids.astype("<i8").tobytes()], [kind], [np.ascontiguousarray(rows).tobytes()], [scale.astype("<f8").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["ids", "kind", "rows", "scale"])


def _pack(unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(a, BLOCK_VECTORS)
                yield _block(part.column(0).to_numpy(), "f8", _matrix(part.column(1), unit).astype("<f8"), np.ones(part.num_rows))

    return run


def _pack_stored(width: int, unit: bool):
    """Blocks of stored bytes as they are; ``scale`` has what a row's numbers are to be multiplied by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(a, BLOCK_VECTORS)
                ids, steps = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False).astype(float)
                for kind, (at, rows) in blob_rows(part.column(1), width).items():
                    length = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
                    scale = np.where(length > 0, 1 / np.where(length > 0, length, 1), 0) if unit else steps[at] if kind == "i1" else np.ones(len(at))
                    sound = np.isfinite(length) & np.isfinite(scale)
                    if sound.any():
                        yield _block(ids[at][sound], kind, rows[sound], scale[sound])

    return run


def _dot(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """All inner products in double precision; those of int8 codes are integers, which single precision has exactly up to 2**24."""
    codes = q.dtype == d.dtype == np.int8
    kind = np.float32 if codes and q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return (q.astype(kind) @ d.astype(kind).T).astype(np.float64)


def _product(k: int | None, least: float | None, apart: tuple[int, int, float, float] | None):
    """``apart``: (first, last, floor, gap): what may reach the floor and the mean of these ranks plus the gap, and the last + 1 best."""
    best = k if k is not None else apart[1] + 1 if apart else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}  # the best scores of each query of a block so far, in ascending order
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_kind, q_rows, q_scale, ids, kind, rows, scale = (c[row].as_py() for c in batch.columns)
                q, d = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                of = lambda data, kind, n: np.frombuffer(data, {"f8": "<f8", "f4": "<f4", "i1": "i1"}[kind]).reshape(n, -1)
                asked, vectors = of(q_rows, q_kind, len(q)), of(rows, kind, len(d))
                q_scales, scales = np.frombuffer(q_scale, "<f8"), np.frombuffer(scale, "<f8")
                if best is not None and q_ids not in seen:
                    seen[q_ids] = np.full((len(q), best), -np.inf)
                step = max(1, SLICE // max(1, len(d)))
                for a in range(0, len(q), step):
                    part = slice(a, a + step)
                    scores = _dot(asked[part], vectors)
                    scores *= q_scales[part, None]
                    scores *= scales
                    np.round(scores, 6, out=scores)
                    keep = q[part, None] != d[None, :]
                    if least is not None:
                        keep &= scores >= least
                    if best is not None:
                        known = seen[q_ids][part]
                        fresh = np.where(keep & (scores == scores), scores, -np.inf)
                        if fresh.shape[1] > best:
                            fresh = np.partition(fresh, -best, axis=1)[:, -best:]
                        known[:] = np.sort(np.concatenate([known, fresh], axis=1), axis=1)[:, -best:]
                        # all that reach the best scores so far, so that ties are decided where all blocks meet
                        bar = known[:, 0]
                        if apart:
                            first, last, floor, gap = apart
                            # the mean of these ranks among all rows is no less than among those seen so far
                            back = known[:, best - last : best - first + 1].mean(axis=1) + gap - 1e-9
                            bar = np.minimum(bar, np.maximum(back, floor))
                        keep &= scores >= bar[:, None]
                    i, j = np.nonzero(keep)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(q[part][i]), pa.array(d[j]), pa.array(scores[i, j])], ["q", "doc", "score"])

    return run


def _meet(packed: DataFrame, dealt: DataFrame, blocks: int, n_bytes: int, k: int | None, least: float | None, apart: tuple[int, int, float, float] | None = None) -> DataFrame:
    bound_batches(packed.sparkSession)  # a row is a pair of blocks: some MB
    sides = dealt.select(F.pmod(F.xxhash64("ids"), F.lit(blocks)).alias("block"), *[F.col(c).alias(f"q_{c}") for c in dealt.columns])
    if n_bytes <= BROADCAST_BYTES:
        sides = F.broadcast(sides)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    pairs = packed.withColumn("block", every).join(sides, "block").select(*[f"q_{c}" for c in dealt.columns], *packed.columns)
    found = pairs.mapInArrow(_product(k, least, apart), "q long, doc long, score double")
    return found if k is None else top_k(found, k)


def similar(vectors: DataFrame, queries: DataFrame, *, k: int | None = None, least: float | None = None, apart: tuple[int, int, float, float] | None = None, unit: bool = True) -> DataFrame:
    """(q, doc, score[, rank]): cosine (``unit``) or inner product of each query with each vector but its own, rounded to six decimals.

    vectors: (doc, embedding), queries: (q, asked). With ``k`` the best of each query (ties: smaller doc) and their rank;
    with ``least`` those of that score or more; with ``apart`` (``ranking.background``) all that ``ranking.distinct_floor`` of the same values keeps,
    and what it needs to find that. Vectors that are null, hold nulls or
    are not as long as the longest query take no part.
    """
    width = queries.agg(F.max(F.size("asked"))).first()[0] or 0
    sound = lambda df, c: df.where((F.size(c) == width) & ~F.exists(c, lambda x: x.isNull()))
    packed = sound(vectors.select(F.col("doc").cast("long"), "embedding"), "embedding").mapInArrow(_pack(unit), _BLOCK)
    asked = sound(queries.select(F.col("q").cast("long"), "asked"), "asked")
    n = asked.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    dealt = asked.repartition(blocks, "q").mapInArrow(_pack(unit), _BLOCK)
    return _meet(packed, dealt, blocks, n * (width + 1) * 8, k, least, apart)


def similar_stored(stored: DataFrame, queries: DataFrame, width: int, *, k: int | None = None, least: float | None = None, unit: bool = True) -> DataFrame:
    """As ``similar`` for vectors stored as bytes: 4 * width of 32-bit floats or width of int8 codes, in one table in any mixture.

    stored: (doc, blob, step), queries: (q, asked, step) with bytes of either kind; an int8 row's numbers are its codes times
    its step, which a cosine doesn't need. Blocks travel as the bytes that are stored (an int8 block has a
    quarter of a float one) and are never dequantised: a product is taken of codes and multiplied by the steps,
    exactly where both are codes. Rows of any other length, null ones and not finite ones take no part (``stored_kinds`` counts them).
    """
    take = lambda df, i, c: df.select(F.col(i).cast("long"), c, F.col("step").cast("double"))
    packed = take(stored, "doc", "blob").where("doc IS NOT NULL").mapInArrow(_pack_stored(width, unit), _BLOCK)
    asked = take(queries, "q", "asked").where("q IS NOT NULL")
    n = asked.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    dealt = asked.repartition(blocks, "q").mapInArrow(_pack_stored(width, unit), _BLOCK)
    return _meet(packed, dealt, blocks, n * (4 * width + 16), k, least)


def kind_of(blob: Column, width: int) -> Column:
    """'float', 'int8', or 'broken' for any other length (or none)."""
    size = F.octet_length(blob)
    return F.when(size == 4 * width, "float").when(size == width, "int8").otherwise("broken")


def stored_kinds(stored: DataFrame, width: int) -> DataFrame:
    """(kind, n, bytes) of the stored rows: float, int8, broken."""
    return stored.groupBy(kind_of(F.col("blob"), width).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("blob"), F.lit(0))).alias("bytes"))


def migrated(stored: DataFrame, width: int) -> DataFrame:
    """The stored rows with floats rewritten as int8 codes and their step; rows that are int8 already, broken or not finite, stay as they are, so a run that is repeated or resumed changes nothing."""
    numbers = from_blob(F.col("blob"), width, F.lit(1.0))
    finite = F.forall(numbers, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    floats = F.coalesce((kind_of(F.col("blob"), width) == "float") & finite, F.lit(False))
    rows = stored.withColumn("__numbers", F.when(floats, numbers)).withColumn("__step", quantise_scale(F.col("__numbers")))
    codes = as_blob(quantise(F.col("__numbers"), F.col("__step")), "int8")
    return rows.withColumns({"blob": F.when(floats, codes).otherwise(F.col("blob")), "step": F.when(floats, F.col("__step")).otherwise(F.col("step"))}).drop("__numbers", "__step")

"""MinHash near-duplicate groups with a circulant signature, banding and exact Jaccard verification.

The signature needs two permutations of the 32-bit integers: ``sigma`` spreads the shingles, and the k-th
coordinate is the minimum of ``pi`` shifted circularly by k, ``min(pi((sigma(x) + k) mod 2**32))``.

1. Texts become sets of distinct k-word shingles (64-bit hashes). Equal sets collapse to one class, whose
   representative is its smallest id, so copies cost one row.
2. Bands of the signatures put representatives into buckets. The number of bands is chosen so that a pair
   at the threshold shares no bucket with a probability under one in a million.
3. Each member is compared with its bucket's smallest id (its pivot) on the full sets, never with all others.
4. Links give components. Two members of one bucket in different components are the only pairs left that
   could matter. They are compared exactly through their differences from the pivot's set
   (|x & y| = |p| - |rx | ry| + |ax & ay|), in blocks of bounded size, so no bucket is ever expanded to pairs.

Rows: one for each input row. Null or empty texts have an empty set and are linked with nothing. A null id
links with nothing, is kept and has a null component. Rows that share an id count as one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import bytewords as bw
from evispark.llm.tables import components, key_filter, may_hold, with_class, written

#: Coordinates in a band; members that one block of step 4 compares with another block's.
BAND_ROWS, BLOCK_ROWS = 4, 256


def bands_for(percent: int, rows: int = BAND_ROWS, miss: float = 1e-6) -> int:
    """The fewest bands with which a pair at the threshold is missed with a probability of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _sigma(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Mixes ``x`` in place; a permutation of the 32-bit integers."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signature(hashes: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """``width`` circulant MinHash coordinates of each set; ``begin`` has where each (non-empty) set starts."""
    base, out = _sigma((hashes >> np.uint64(32)).astype(np.uint32)), np.empty((width, len(begin)), np.uint32)
    x, spare = np.empty_like(base), np.empty_like(base)
    for k in range(width):
        np.add(base, np.uint32(k), out=x)
        out[k] = np.minimum.reduceat(_pi(x, spare), begin)
    return out


def distinct_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows, one row after another, and the number for each row."""
    rows = len(column)
    h, row = bw.words(column)
    g, at = bw.shingles(h, row, rows, k)
    ends = np.searchsorted(at, np.arange(rows + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (at[1:] != at[:-1])
    return g[keep], np.bincount(at[keep], minlength=rows)


def _longs(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _profiles(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bw.slices(batch.column(1), 1 << 20):
                sets, n = distinct_sets(batch.column(1).slice(a, b - a), k)
                some = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[some]
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if len(some):
                    one[some] = np.add.reduceat(bw.mix64(sets ^ np.uint64(0x51ED270B)), begin)
                    two[some] = np.add.reduceat(bw.mix64(sets ^ np.uint64(0xA3C59AC3F1E2D4B7)), begin)
                    sig = signature(sets, begin, bands * BAND_ROWS).astype(np.uint64)
                    keys = np.empty((len(some), bands), np.uint64)
                    for i in range(bands):
                        key = np.full(len(some), i + 1, np.uint64)
                        for j in range(BAND_ROWS):
                            key = bw.mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[i * BAND_ROWS + j])
                        keys[:, i] = key
                arrays = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _longs(keys.reshape(-1), np.where(n > 0, bands, 0))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "one", "two", "bands"])

    return run


def _sets(k: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(held.value, batch.column(2).to_numpy())))
            for a, b in bw.slices(batch.column(1), 1 << 20):
                sets, n = distinct_sets(batch.column(1).slice(a, b - a), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _longs(sets, n)], ["id", "tokens"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    sizes = [len(x) for x in (*left, *right)]
    flat = np.concatenate([*left, *right]) if sizes else np.zeros(0, np.int64)
    values, column = np.unique(flat, return_inverse=True)
    if len(values) * len(sizes) <= 1 << 24:
        dense = np.zeros((len(sizes), len(values)), np.float32)
        dense[np.repeat(np.arange(len(sizes)), sizes), column] = 1
        return (dense[: len(left)] @ dense[len(left) :].T).astype(np.int64)
    ends = np.cumsum([0, *sizes])
    each = [set(column[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.array([[len(x & y) for y in each[len(left) :]] for x in each[: len(left)]], np.int64).reshape(len(left), len(right))


def _rest(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"].iat[0], rows["high"].iat[0]
        x = rows[rows["block"] == low].reset_index(drop=True)
        y = x if low == high else rows[rows["block"] == high].reset_index(drop=True)
        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        arrays = lambda col: [np.asarray(v, np.int64) for v in col]
        removed, added = (arrays(x["removed"]), arrays(y["removed"])), (arrays(x["added"]), arrays(y["added"]))
        size = lambda part: np.array([len(v) for v in part])
        shared = rows["pivot_n"].iat[0] - (size(removed[0])[:, None] + size(removed[1])[None, :] - _overlaps(*removed)) + _overlaps(*added)
        union = x["n"].to_numpy()[:, None] + y["n"].to_numpy()[None, :] - shared
        links = (100 * shared >= percent * union) & (x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :])
        i, j = np.nonzero(links)
        found = pd.DataFrame({"a": x["id"].to_numpy()[i], "b": y["id"].to_numpy()[j], "x": x["comp"].to_numpy()[i], "y": y["comp"].to_numpy()[j]})
        return found.drop_duplicates(["x", "y"])[["a", "b"]]

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; texts of Jaccard similarity >= percent/100 are linked."""
    bands = bands_for(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles = written(texts.mapInArrow(_profiles(shingle, bands), "id long, n long, one long, two long, bands array<long>"), "profiles")
    some = profiles.where("n > 0 AND id IS NOT NULL")
    # equal sets have equal bands, so that copies are folded where they are
    of_class = ["n", "one", "two"]
    classes = written(some.groupBy(*of_class).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    keyed = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("last")).where("low.id < last").select("key", F.col("low.id").alias("pivot"), F.col("low.n").alias("pivot_n"))
    pairs = written(keyed.join(buckets, "key").where("id <> pivot").select("pivot", "pivot_n", "id", "n").distinct(), "pairs")
    wanted = written(pairs.select("id").union(pairs.select("pivot")).distinct(), "wanted")
    # the scan drops texts that no pair wants, so no text is shuffled; the join drops the few that slip through
    hashed = texts.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h"))
    sets = hashed.mapInArrow(_sets(shingle, key_filter(wanted.select(F.xxhash64("id")))), "id long, tokens array<long>")
    sets = written(sets.join(wanted, "id").dropDuplicates(["id", "tokens"]), "sets")
    pivots = sets.select(F.col("id").alias("pivot"), F.col("tokens").alias("pivot_tokens"))
    # sizes alone rule out some pairs: the intersection is the smaller set at most
    both = pairs.where(100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")).join(sets, "id").join(pivots, "pivot")
    shared = F.size(F.array_intersect("tokens", "pivot_tokens"))
    star = both.where(100 * shared >= percent * (F.size("tokens") + F.size("pivot_tokens") - shared)).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    star = written(star.distinct(), "star")
    first = written(components(star), "components")
    comp = lambda of, name: first.select(F.col("node").alias(of), F.col("component").alias(name))
    placed = (
        pairs.join(comp("id", "c"), "id", "left").join(comp("pivot", "p"), "pivot", "left")
        .select("pivot", "id", F.coalesce("c", "id").alias("comp"), F.coalesce("p", "pivot").alias("pivot_comp"))
    )
    # members in the pivot's component and out of it; of the former no two need be compared
    own = F.col("comp") == F.col("pivot_comp")
    groups = placed.groupBy("pivot").agg(F.count_if(own).alias("in"), F.count_if(~own).alias("out"), F.min("comp").alias("low_comp"), F.max("comp").alias("high_comp"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int").alias(f"{c}_blocks")
    open_groups = groups.where("out > 0 AND low_comp <> high_comp").select("pivot", blocks("in"), blocks("out"))
    dealt = placed.join(open_groups, "pivot").join(sets, "id").join(pivots, "pivot")
    inner, every = F.col("in_blocks"), F.col("in_blocks") + F.col("out_blocks")
    place = F.when(own, F.pmod(F.xxhash64("id"), F.greatest(inner, F.lit(1)))).otherwise(inner + F.pmod(F.xxhash64("id"), F.greatest(F.col("out_blocks"), F.lit(1))))
    parts = dealt.select(
        "pivot", "id", "comp", F.size("tokens").alias("n"), F.size("pivot_tokens").alias("pivot_n"),
        F.array_except("pivot_tokens", "tokens").alias("removed"), F.array_except("tokens", "pivot_tokens").alias("added"),
        place.cast("int").alias("block"), F.explode(F.sequence(F.when(own, inner).otherwise(F.lit(0)), every - 1)).alias("other"),
    ).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    rest = parts.groupBy("pivot", "low", "high").applyInPandas(_rest(percent), "a long, b long")
    rest = written(rest, "rest")
    if rest.isEmpty():
        final = first
    else:
        final = written(components(star.unionByName(rest)), "components")
    named = final.select(F.col("node").alias("rep"), "component")
    fates = written(classes.drop("bands").join(named, "rep", "left").select(*of_class, "copies", F.coalesce("component", "rep").alias("label")), "fates")
    rows = with_class(profiles.select("id", *of_class), fates, of_class, "copies").select("id", "label")
    label = F.coalesce("label", "id")
    labels = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))  # rows that share an id are one document
    return profiles.select("id", "n").join(labels, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(label == F.col("id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the smallest id; all columns stay as they are.

    Rows that share an id with equal texts are one document and are all kept or dropped together.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["gone"], "left_anti")

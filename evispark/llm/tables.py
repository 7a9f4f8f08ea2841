"""Intermediate tables in the shared folder, size-checked broadcasts, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below the one that ``spark.checkpoint.dir`` names; its owner may remove it when all results were read.

    Where the setting is unset: one temporary folder on a local master, an error on any other, whose executors share none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evispark-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/evispark/{spark.sparkContext.applicationId}"


#: Bytes of an Arrow batch between Spark and its Python workers; the default, 10,000 rows, says nothing of long texts.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """From now on the session's Arrow batches have BATCH_BYTES at most (or one row)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and outlives any executor."""
    spark = bound_batches(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A broadcast hint only where the counted ``rows`` are within the bound; else Spark picks a shuffled join."""
    return F.broadcast(df) if rows <= most else df


#: A class with more than this share of all rows is joined by a broadcast; there are at most as many as its inverse.
HEAVY = 2000


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their class; ``classes`` has one row for each key, with the number of its rows in ``size``.

    The classes that hold more than one in HEAVY of all rows (fewer than HEAVY, whatever the data) are broadcast, so that
    their rows stay where they are; only the others' rows are shuffled. Both tables are read twice: pass written ones.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    heavy = classes.where(F.col(size) * HEAVY > total)
    light = classes.where(F.col(size) * HEAVY <= total)
    few = F.broadcast(heavy)
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay as they are: each step is an
    aggregate with map-side combine and an equi-join (split by AQE where one node is hot), and its
    edges are written to the shared folder.  No edges: an empty result.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


#: 64-bit words of a filter: 2 MB, whatever the number of keys.
FILTER_WORDS = 1 << 18


def key_filter(hashes: DataFrame):
    """A broadcast bit table that has every value of the one column of ``hashes`` (64-bit hashes), and few others.

    Its size is fixed, so a scan can drop rows that a later exact join would drop, before anything is
    shuffled; with very many keys it lets more rows pass, and the join is what decides. The bits are set by
    an aggregate; the driver sees FILTER_WORDS rows at most. Test with ``may_hold``.
    """
    h = hashes.select(F.col(hashes.columns[0]).alias("h")).select(F.explode(F.array(F.col("h"), F.shiftright("h", 24))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.pmod(F.shiftright("h", 6), F.lit(FILTER_WORDS)).cast("int")
    rows = h.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_WORDS, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table)


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of these hashes."""
    return np.logical_and.reduce([(table[np.mod(x >> 6, FILTER_WORDS)] >> (x & 63)) & 1 == 1 for x in (h, h >> 24)])

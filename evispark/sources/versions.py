"""Tables that are replaced by parent, and ledgers that only grow: what is half written is never read.

A table is a folder of Parquet:

    rows/write=<n>      what a write brought
    parents/write=<n>   the parents that it replaced, with or without rows
    done/write=<n>      one row, written last: only such writes count

A parent's rows are those of its last write. A write that fails leaves no ``done``, so readers go on with what was there, and its
repetition under the same number begins anew. Nothing is ever changed in place, so a reader that started before sees its own
state to the end. ``compacted`` writes what counts as the first write of another folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _done(spark: SparkSession, path: str) -> DataFrame | None:
    found = _there(spark, f"{path}/done")
    return None if found is None else found.select(F.col("write").cast("long").alias("write"))


def last_write(spark: SparkSession, path: str) -> int:
    """The number of the last write that counts; 0 if there is none."""
    done = _done(spark, path)
    return 0 if done is None else done.agg(F.max("write")).first()[0] or 0


def replace_children(spark: SparkSession, path: str, rows: DataFrame, parent: str, *, gone: DataFrame | None = None, number: int | None = None) -> int:
    """Puts ``rows`` in the place of all rows of their parents, and takes the rows of the parents in ``gone`` (one column) away; gives the write's number.

    With ``number`` a write can be repeated: the same again changes nothing. Rows without a parent are children of null.
    """
    number = number or last_write(spark, path) + 1
    touched = rows.select(parent) if gone is None else rows.select(parent).unionByName(gone.select(F.col(gone.columns[0]).alias(parent)))
    rows.write.mode("overwrite").parquet(f"{path}/rows/write={number}")
    touched.distinct().write.mode("overwrite").parquet(f"{path}/parents/write={number}")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/done/write={number}")
    return number


def current(spark: SparkSession, path: str, parent: str) -> DataFrame:
    """The rows that count; an error if nothing was ever written."""
    done, rows, parents = _done(spark, path), _there(spark, f"{path}/rows"), _there(spark, f"{path}/parents")
    if done is None or rows is None or parents is None:
        raise ValueError(f"no table at {path}")
    last = parents.join(done, "write", "left_semi").groupBy(parent).agg(F.max("write").alias("__last"))
    same = (F.col("r.write") == F.col("p.__last")) & F.col(f"r.{parent}").eqNullSafe(F.col(f"p.{parent}"))
    return rows.alias("r").join(last.alias("p"), same, "left_semi").drop("write")


def compacted(spark: SparkSession, path: str, target: str, parent: str) -> None:
    """What counts, as the only write of a new folder."""
    replace_children(spark, target, current(spark, path, parent), parent, number=1)


def lost_from(baseline: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``baseline`` that ``now`` lacks; nulls are values like others."""
    a, b = baseline.select(*keys).distinct().alias("a"), now.select(*keys).distinct().alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same, "left_anti")


def grow_ledger(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> int:
    """Replaces a ledger by ``rows`` unless they lack a key that it has: then a ValueError says how many, and all stays as it was.

    A ledger is a table with one parent, so a write replaces all of it at once.
    """
    whole = rows.withColumn("__ledger", F.lit(0))
    if last_write(spark, path):
        lost = lost_from(current(spark, path, "__ledger"), rows, keys)
        n = lost.count()
        if n:
            raise ValueError(f"the ledger would lose {n} keys, such as {[tuple(r) for r in lost.orderBy(*keys).limit(5).collect()]}")
    return replace_children(spark, path, whole, "__ledger", gone=spark.createDataFrame([(0,)], "p int"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows."""
    return current(spark, path, "__ledger").drop("__ledger")

"""Broadcast hints that are given only after the side's bytes were counted, and bounded Arrow batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side is broadcast.
BROADCAST_BYTES = 32 << 20

#: Bytes of an Arrow batch between Spark and its Python workers; the default, 10,000 rows, says nothing of long rows.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """From now on the session's Arrow batches have BATCH_BYTES at most (or one row)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def stored_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take, by one aggregate over them."""
    parts = [F.lit(16)]
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(field.name), F.lit(0)))
        elif isinstance(field.dataType, T.ArrayType):
            parts.append(16 * F.greatest(F.size(field.name), F.lit(0)))
        else:
            parts.append(F.lit(8))
    return df.agg(F.sum(reduce(lambda a, b: a + b, parts).cast("long"))).first()[0] or 0


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it takes at most ``most`` bytes; else Spark joins it by a shuffle."""
    return F.broadcast(df) if stored_bytes(df) <= most else df

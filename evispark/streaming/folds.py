"""The stateful rules on streams: per-key quotas and replay-safe de-duplication.

``quota_stream`` is ``operators.stateful.quota`` for Structured Streaming: one small state row for each key,
dropped when its window is over. ``unique_stream`` relies on Spark's own watermark de-duplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quota_stream(events: DataFrame, key: str, time: str, id_col: str, *, seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """(key, id, window_start, accepted) for each event, in event order within a batch; windows start at a key's first event.

    An event older than its key's window counts in that window. State leaves once the watermark passes its window.
    """
    span = seconds * 1_000_000
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(time).cast("timestamp").alias("ts")).withWatermark("ts", late)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(frames)).sort_values(["ts", "id"])
        micros = pdf["ts"].astype("datetime64[us]").astype("int64")
        starts, accepted = [], []
        for t in micros:
            if start is None or t - start >= span:
                start, used = int(t), 0
            used += 1
            starts.append(start)
            accepted.append(used <= most)
        state.update((start, used))
        ends = (start + span) // 1000
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({"key": k[0], "id": pdf["id"].to_numpy(), "window_start": starts, "accepted": accepted})

    return rows.groupBy("key").applyInPandasWithState(run, "key string, id long, window_start long, accepted boolean", "start long, used long", "append", GroupStateTimeout.EventTimeTimeout)


def unique_stream(events: DataFrame, keys: list[str], time: str, *, within: str = "10 minutes") -> DataFrame:
    """Events whose key was not seen before within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark(keys)

"""Sliding rates: known rhythms, edges, and streams that give what batches give."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from evispark.operators import rates

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, i long, ts timestamp, a double, b double"


def swing(key, bpm, seconds, first=0, hz=30, seed=1, noise=0.1, start=0.0):
    """Steps of a sine of this rate in the second channel, noise in the first."""
    rng = random.Random(seed)
    at = [k / hz + rng.uniform(-0.004, 0.004) for k in range(int(seconds * hz))]
    level = [4 * math.sin(2 * math.pi * bpm / 60 * t) for t in at]
    steps = [y - x for x, y in zip([level[0], *level], level, strict=False)]
    return [(key, first + n, START + dt.timedelta(seconds=start + t + 1), rng.gauss(0, noise), s + rng.gauss(0, noise / 5)) for n, (t, s) in enumerate(zip(at, steps, strict=True))]


def found(spark, rows, **how):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return {r.i: r for r in rates.sliding_rates(frame, ["k"], "ts", "i", [F.col("a"), F.col("b")], **how).collect()}


@pytest.mark.parametrize("bpm", [65, 100, 118, 160])
def test_known_rhythms(spark, bpm):
    got = found(spark, swing("x", bpm, 9))
    assert all(got[i].rate is None for i in range(120))  # less than four seconds
    late = [got[i] for i in range(200, len(got))]
    assert all(abs(r.rate - bpm) <= 2 and r.channel == 1 and r.confidence > 0.6 for r in late)


def test_no_rhythm(spark):
    still = [("s", k, START + dt.timedelta(seconds=k / 30), 0.0, None) for k in range(240)]
    rng = random.Random(3)
    noise = [("n", 1000 + k, START + dt.timedelta(seconds=k / 30), rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(240)]
    sparse = swing("p", 100, 9, 2000, hz=10)
    twice = [(k, i + 3000, t, a, b) for k, i, t, a, b in swing("t", 100, 9)]
    twice += [("t", 4000, twice[150][2], 0.0, 0.0)]
    got = found(spark, still + noise + sparse + twice + [("z", 5000, None, 1.0, 1.0)])
    assert all(got[i].rate is None for i in (*range(240), *range(2000, 2090)))
    assert sum(got[i].rate is not None for i in range(1000, 1240)) < 24
    assert all(got[i].rate is None for i in range(3152, 3269)) and 5000 not in got


def test_old_samples_leave_the_window(spark):
    rows = swing("x", 100, 8) + swing("x", 150, 8, 500, start=30.0)
    got = found(spark, rows)
    assert all(got[500 + i].rate is None for i in range(119)) and abs(got[500 + 230].rate - 150) <= 2


def test_stream_equals_batch(spark, tmp_path):
    rows = swing("x", 100, 8) + swing("y", 140, 8, 1000, seed=2)
    batch = found(spark, rows)
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    for part in range(4):
        mine = [r for r in rows if part * 2 <= (r[2] - START).total_seconds() - 1 < part * 2 + 2 or part == 0 and (r[2] - START).total_seconds() < 1 or part == 3 and (r[2] - START).total_seconds() >= 9]
        spark.createDataFrame(mine, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rates.rate_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", "ts", "i", [F.col("a"), F.col("b")])
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got[r.id] = (r.rate, r.confidence, r.channel)
    assert set(got) == set(batch)
    for i, r in batch.items():
        assert got[i] == (r.rate, r.confidence, r.channel) or got[i] == pytest.approx((r.rate, r.confidence, r.channel))


def test_no_samples(spark):
    assert found(spark, []) == {}

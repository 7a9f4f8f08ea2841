"""The forward as-of join against a plain one, its edges, and its time over one key."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evispark.operators import tables as tb

LEFT, RIGHT = "k string, t long, name int, next_value string, __t int", "k string, at long, v string, place int"


def plain(left, right, strict, within):
    out = {}
    for k, t, name, *_ in left:
        after = [r for r in right if r[0] == k and k is not None and None not in (t, r[1]) and (r[1] > t if strict else r[1] >= t)]
        first = min(after, key=lambda r: (r[1], r[3]), default=None)
        out[name] = (first[1], first[2]) if first and (within is None or first[1] <= t + within) else (None, None)
    return out


@pytest.mark.parametrize("cells", [1, 3, 256])
@pytest.mark.parametrize("strict, within", [(False, None), (True, None), (False, 7), (True, 7)])
def test_equals_a_plain_join(spark, cells, strict, within):
    rng = random.Random(cells)
    keys = ["a", "a", "a", "b", "c", None]
    left = [(rng.choice(keys), rng.choice([None, *range(60)]), i, "x", 1) for i in range(150)]
    right = [(rng.choice(keys[:4] + [None]), rng.choice([None, *range(0, 90, 3)]), rng.choice(["p", "q", None]), i) for i in range(60)]
    found = tb.next_event(
        spark.createDataFrame(left, LEFT).withColumnsRenamed({"next_value": "other", "__t": "extra"}), spark.createDataFrame(right, RIGHT), ["k"], "t", "at", "v",
        strict=strict, within=within and str(within), ties=["place"], cells=cells,
    )
    assert found.columns == ["k", "t", "name", "other", "extra", "next_time", "next_value"]
    got = {r.name: (r.next_time, r.next_value) for r in found.collect()}
    assert got == plain(left, right, strict, within)


def test_no_rows_on_a_side(spark):
    left, right = spark.createDataFrame([("a", 1, 1)], "k string, t long, name int"), spark.createDataFrame([("a", 1, "x")], "k string, at long, v string")
    assert [tuple(r) for r in tb.next_event(left, right.limit(0), ["k"], "t", "at", "v").collect()] == [("a", 1, 1, None, None)]
    assert tb.next_event(left.limit(0), right, ["k"], "t", "at", "v").collect() == []
    assert tb.next_event(left.limit(0), right.limit(0), ["k"], "t", "at", "v").collect() == []


def test_repeated_rows_keep_theirs(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", 1, "x")], "k string, at long, v string")
    assert [tuple(r) for r in tb.next_event(left, right, ["k"], "t", "at", "v").collect()] == [("a", 1, 1, "x")] * 2


def seconds(spark, n, cells):
    rows = spark.range(n).select(F.lit("one").alias("k"), F.col("id").alias("t"), F.hash("id").alias("v"))
    left, right = rows.where("v % 2 = 0").select("k", "t"), rows.where("v % 2 <> 0").select("k", F.col("t").alias("at"), "v")
    began = time.perf_counter()
    tb.next_event(left, right, ["k"], "t", "at", "v", cells=cells).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@pytest.mark.parametrize("cells", [1, 256])
def test_time_is_linear_in_a_key(spark, cells):
    seconds(spark, 1000, cells)
    small, large = seconds(spark, 32_000, cells), seconds(spark, 320_000, cells)
    assert large < 10 * small + 5 and large < 25

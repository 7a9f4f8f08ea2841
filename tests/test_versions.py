"""Tables replaced by parent and ledgers: round trips, and writes that fail."""

import pytest
from pyspark.sql import functions as F

from evispark.sources import versions as vs


def rows(spark, *data):
    return spark.createDataFrame(list(data), "file string, n int")


def state(spark, path):
    return sorted(((r.file, r.n) for r in vs.current(spark, path, "file").collect()), key=repr)


def test_parents_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        vs.current(spark, path, "file")
    assert vs.replace_children(spark, path, rows(spark, ("a", 1), ("a", 1), ("b", 2), (None, 3)), "file") == 1
    assert state(spark, path) == [("a", 1), ("a", 1), ("b", 2), (None, 3)]
    assert vs.replace_children(spark, path, rows(spark, ("a", 9), ("c", 4)), "file") == 2
    assert state(spark, path) == [("a", 9), ("b", 2), ("c", 4), (None, 3)]
    vs.replace_children(spark, path, rows(spark, ("x", 0)).limit(0), "file", gone=spark.createDataFrame([("b",), (None,)], "p string"))
    assert state(spark, path) == [("a", 9), ("c", 4)]
    vs.replace_children(spark, path, rows(spark, ("b", 7)), "file", number=4)
    vs.replace_children(spark, path, rows(spark, ("b", 7)), "file", number=4)
    assert state(spark, path) == [("a", 9), ("b", 7), ("c", 4)]
    vs.compacted(spark, path, str(tmp_path / "u"), "file")
    assert state(spark, str(tmp_path / "u")) == state(spark, path) and vs.last_write(spark, str(tmp_path / "u")) == 1


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    vs.replace_children(spark, path, rows(spark, ("a", 1), ("b", 2)), "file")
    broken = rows(spark, ("a", 5), ("b", 6)).repartition(2).withColumn("n", F.when(F.col("n") == 6, F.raise_error(F.lit("lost executor"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost executor"):
        vs.replace_children(spark, path, broken, "file")
    # rows of a write that never ended, and its parents, count nothing
    rows(spark, ("b", 6)).write.parquet(f"{path}/rows/write=3")
    rows(spark, ("b", 6)).select("file").write.parquet(f"{path}/parents/write=3")
    assert state(spark, path) == [("a", 1), ("b", 2)] and vs.last_write(spark, path) == 1
    assert vs.replace_children(spark, path, rows(spark, ("a", 5)), "file") == 2
    assert state(spark, path) == [("a", 5), ("b", 2)]


def test_a_ledger_only_grows(spark, tmp_path):
    path = str(tmp_path / "l")
    vs.grow_ledger(spark, path, rows(spark, ("a", 1), (None, 2)), ["file"])
    vs.grow_ledger(spark, path, rows(spark, ("a", 8), (None, 2), ("b", 3)), ["file"])
    want = [("a", 8), ("b", 3), (None, 2)]
    read = lambda: sorted(((r.file, r.n) for r in vs.ledger(spark, path).collect()), key=repr)
    assert read() == want
    with pytest.raises(ValueError, match="lose 2 keys"):
        vs.grow_ledger(spark, path, rows(spark, ("b", 3), ("c", 1)), ["file"])
    assert read() == want
    assert [r.file for r in vs.lost_from(rows(spark, ("a", 1), (None, 1)), rows(spark, ("a", 2)), ["file"]).collect()] == [None]

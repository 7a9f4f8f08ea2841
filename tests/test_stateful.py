import datetime as dt
import random

from evispark.operators import stateful as st
from evispark.operators import tables as tb
from evispark.streaming import folds

START = dt.datetime(2024, 1, 1)


def events(seed, n=300):
    rng = random.Random(seed)
    return [(i, rng.randrange(6), START + dt.timedelta(seconds=rng.randrange(5000))) for i in range(n)]


def brute_quota(rows, seconds, most):
    out, windows = {}, {}
    for i, user, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start, used = windows.get(user, (None, 0))
        if start is None or (ts - start).total_seconds() >= seconds:
            start, used = ts, 0
        windows[user] = (start, used + 1)
        out[i] = used + 1 <= most
    return out


def test_quota_equals_brute_force(spark):
    rows = events(1)
    frame = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = st.quota(frame, ["user_id"], "ts", ["event_id"], seconds=600, most=7).collect()
    assert {r.event_id: r.accepted for r in got} == brute_quota(rows, 600, 7)


def test_window_ends_exactly_at_its_span(spark):
    rows = [(1, 1, START), (2, 1, START + dt.timedelta(seconds=59)), (3, 1, START + dt.timedelta(seconds=60))]
    got = st.quota(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), ["user_id"], "ts", ["event_id"], seconds=60, most=1).collect()
    assert {r.event_id: r.accepted for r in got} == {1: True, 2: False, 3: True}


def test_quota_stream_equals_batch(spark, tmp_path):
    rows = events(2, 120)
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    out = folds.quota_stream(stream, "user_id", "ts", "event_id", seconds=600, most=7, late="2 hours")
    query = out.writeStream.format("memory").queryName("quota_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.id: r.accepted for r in spark.table("quota_out").collect()} == brute_quota(rows, 600, 7)


def test_unique_stream(spark, tmp_path):
    rows = [(1, "a", START), (2, "a", START + dt.timedelta(seconds=5)), (3, "b", START)]
    spark.createDataFrame(rows, "id long, k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, ts timestamp").parquet(str(tmp_path / "in"))
    query = folds.unique_stream(stream, ["k"], "ts").writeStream.format("memory").queryName("unique_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.k for r in spark.table("unique_out").collect()) == ["a", "b"]


def test_final_state(spark):
    moves = {("new", "a"): "one", ("one", "b"): "two"}
    rows = [(1, "u", START, "a"), (2, "u", START + dt.timedelta(seconds=1), "x"), (3, "u", START + dt.timedelta(seconds=2), "b"), (4, "v", START, "b"), (5, None, START, "a")]
    frame = spark.createDataFrame(rows, "id long, user string, ts timestamp, kind string")
    got = {r.user: (r.state, r.n_moves) for r in st.final_state(frame, ["user"], "ts", "id", "kind", moves, "new").collect()}
    assert got == {"u": ("two", 2), "v": ("new", 0), None: ("one", 1)}


def test_filter_language(spark):
    frame = spark.createDataFrame([("Ana", "1,5"), ("bea", "x"), ("Cid", None)], "Name string, size string")
    keep = lambda f: [r.Name for r in frame.where(tb.parse_filter(frame, f)).collect()]
    assert keep("size>=1.5") == ["Ana"] and keep("NAME=ana;size<2") == ["Ana"] and keep("name!=ana") == ["bea", "Cid"] and keep("") == ["Ana", "bea", "Cid"]

"""The library: decisions in order, batches that come again, streams, failed writes, and fingerprints put in later."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.sources import library as lib


def book(seed, chunks=14):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(chunks * 225))


BATCHES = [
    [(5, book(1)), (6, "short text"), (7, " \n"), (8, None), (9, book(1).replace(" ", "\n"))],
    [(1, book(1)), (2, book(1)[:-20] + " new end"), (3, book(1)[:-20] + " other end"), (4, "short  text "), (10, "short text, longer"), (11, book(2))],
]
WANT = {5: ("new", None), 6: ("new", None), 7: ("empty", None), 8: ("empty", None), 9: ("same", 5), 1: ("same", 5), 2: ("similar", 5), 3: ("similar", 5), 4: ("same", 6), 10: ("new", None), 11: ("new", None)}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, decision string, batch int")


def stored(spark, path):
    return {(r.batch, r.doc_id): (r.decision, r.other) for r in lib.decisions(spark, path).collect()}, sorted((r.batch, r.doc_id) for r in lib.documents(spark, path).collect())


def test_decisions_and_repetition(spark, tmp_path):
    path = str(tmp_path / "library")
    assert stored(spark, path) == ({}, [])
    for number, rows in enumerate(BATCHES):
        lib.import_batch(spark, path, frame(spark, rows), number)
    first = stored(spark, path)
    assert {k[1]: v for k, v in first[0].items()} == WANT
    assert first[1] == [(0, 5), (0, 6), (1, 2), (1, 3), (1, 10), (1, 11)]
    shares = {r.doc_id: r.share for r in lib.decisions(spark, path).where("share IS NOT NULL").collect()}
    assert set(shares) == {2, 3} and all(0.9 <= s < 1 for s in shares.values())
    for number in (1, 0, 1):  # a batch again, in any order, changes nothing where later ones hold nothing of it
        if number:
            lib.import_batch(spark, path, frame(spark, BATCHES[number]), number)
    assert stored(spark, path) == first


def test_a_failed_batch_is_mended_by_its_repetition(spark, tmp_path):
    path = str(tmp_path / "library")
    lib.import_batch(spark, path, frame(spark, BATCHES[0]), 0)
    before = stored(spark, path)
    broken = frame(spark, BATCHES[1]).withColumn("doc_id", F.when(F.col("doc_id") == 11, None).otherwise(F.col("doc_id")))
    with pytest.raises(Exception, match="no doc_id"):
        lib.import_batch(spark, path, broken, 1)
    assert stored(spark, path) == before
    lib.import_batch(spark, path, frame(spark, BATCHES[1]), 1)
    assert {k[1]: v for k, v in stored(spark, path)[0].items()} == WANT


def test_stream_equals_batches(spark, tmp_path):
    path, source = str(tmp_path / "library"), str(tmp_path / "in")
    for rows in BATCHES:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id int, text string").parquet(source)
        lib.import_stream(stream, path, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {k[1]: v for k, v in stored(spark, path)[0].items()} == WANT


def test_most_similar_wins_then_the_earliest(spark):
    whole = book(3, 20)
    rows = [(1, whole[:-20] + " a"), (2, whole + " b"), (3, whole + " b and some words")]
    stored_before = spark.createDataFrame([], lib._DOCUMENTS)
    found = {r.doc_id: r for r in lib.decide(frame(spark, rows), stored_before)[0].collect()}
    assert [found[i].decision for i in (1, 2, 3)] == ["new", "similar", "similar"] and found[2].other == 1 and found[3].other == 1


def test_repeated_chunks_count_as_often_as_they_stand(spark):
    line = "z" * 1800
    rows = [(1, line * 3), (2, line * 12), (3, line * 12 + "y" * 100)]
    found = {r.doc_id: (r.decision, r.other) for r in lib.decide(frame(spark, rows), spark.createDataFrame([], lib._DOCUMENTS))[0].collect()}
    assert found[1] == ("new", None) and found[2] == ("new", None) and found[3] == ("similar", 2)


def test_backfill(spark):
    texts = [("b", 1, "one  text"), ("a", 7, "one text"), ("a", 9, book(4)), (None, 3, "(note)\none text"), ("c", 2, " ")]
    docs = spark.createDataFrame(texts, "collection string, doc_id long, text string")
    chunks = docs.select("collection", "doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("pos", "body")).unionByName(spark.createDataFrame([("d", 4, 0, None)], "collection string, doc_id long, pos int, body string"))
    found = {(r.collection, r.doc_id): (r.print, r.twin_of) for r in lib.backfill(chunks, docs.where("doc_id = 7"), notes=["(note)\n"]).collect()}
    want = {r.doc_id: r.p for r in docs.select("doc_id", tx.fingerprint(F.col("text")).alias("p")).collect()}
    assert found == {("b", 1): (want[7], 3), ("a", 9): (want[9], None), (None, 3): (want[7], None), ("d", 4): (None, None)}


def test_texts_are_not_shuffled(spark, tmp_path):
    """The plans of an import hash rows by ids, prints and keys, but for repeated rows of an id."""
    path = str(tmp_path / "library")
    frame(spark, BATCHES[0]).write.parquet(f"{path}-in")
    batch = spark.read.parquet(f"{path}-in")
    lib.import_batch(spark, path, batch, 0)
    decided, fresh = lib.decide(batch, lib.documents(spark, path).where("batch <> 0"))
    rows = [(1, "one\ntwo"), (1, " one two"), (1, None), (2, "three"), (2, "three"), (3, None)]
    got = {r.doc_id: r.text for r in lib.decide(frame(spark, rows), spark.createDataFrame([], lib._DOCUMENTS))[1].collect()}
    assert set(got) == {1, 2} and got[2] == "three" and got[1] in ("one\ntwo", " one two")
    shuffled = [line for line in decided._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip(" :+-").startswith(("Aggregate", "Join"))]
    assert shuffled and "text#" not in " ".join(shuffled)

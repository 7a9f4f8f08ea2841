from pyspark.sql import functions as F

from evispark.functions import dates as dx
from evispark.functions import text as tx
from evispark.functions import vectors as vx
from evispark.operators import ranking as rk
from evispark.operators import tables as tb


def one(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(column.alias("x")).first().x


def test_text(spark):
    t = F.col("t")
    assert one(spark, tx.tokens(t), t="Ñandú, ÁRBOL-3!") == ["nandu", "arbol", "3"]
    assert one(spark, tx.tokens(t), t=None) == []
    assert [one(spark, tx.singular_forms(t), t=w) for w in ("cities", "boxes", "cars", "glass", "bus", "is")] == [["city"], ["box", "boxe"], ["car"], [], [], []]
    assert [one(spark, tx.prefix_form(t), t=w) for w in ("abcde", "abcdefgh", "abcd", "abc12")] == ["abcd", "abcdef", None, None]
    assert [one(spark, tx.delimiter(t), t=h) for h in ("a,b;c,d", "a;b;c", "a|b|c,d", "ab")] == [",", ";", "|", ","]
    assert one(spark, tx.sentences(t), t="One. Two? no. Three!\nfour") == ["One.", "Two? no.", "Three!", "four"]
    assert one(spark, tx.html_to_text(t), t="<p>a &amp; b</p><script>x</script> <!-- c -->d") == "a & b d"
    assert [len(c) for c in one(spark, tx.chunks(t), t="x" * 4100)] == [2000, 2000, 500]
    assert one(spark, tx.chunks(t), t="") == []
    assert one(spark, tx.version_key(t), t="v1.10.2") == [1, 10, 2]
    assert [one(spark, tx.label(t), t=w) for w in ("ok_1", "No", "1a")] == ["ok_1", "other", "other"]


def test_vectors(spark):
    a = F.col("a")
    assert one(spark, vx.cosine(a, F.lit([0.0, 0.0])), a=[1.0, 2.0]) == 0
    assert one(spark, vx.quantise(a, F.lit(1.0)), a=[-2.5, 2.5, 0.5]) == [-2, 3, 1]  # halves towards plus infinity
    assert one(spark, vx.quantise_scale(a), a=[0.0, 0.0]) == 1.0


def test_dates(spark):
    d = lambda s: F.to_date(F.lit(s))
    got = spark.range(1).select(
        dx.next_monthly(d("2024-01-31"), d("2024-01-31")).alias("a"), dx.next_monthly(d("2024-01-31"), d("2024-04-30")).alias("b"), dx.next_anniversary(d("2000-02-29"), d("2025-01-01")).alias("c"),
        dx.next_anniversary(d("2000-05-05"), d("2025-05-05")).alias("e"), dx.next_weekday(d("2024-01-01"), 1).alias("f"), dx.previous_weekday(d("2024-01-01"), 1).alias("g"),
    ).first()
    assert [str(x) for x in got] == ["2024-03-31", "2024-05-31", "2028-02-29", "2025-05-05", "2024-01-08", "2023-12-25"]


def test_ranking_rules(spark):
    flat = spark.createDataFrame([("q", i, 1.0) for i in range(3)] + [("r", 9, 5.0)], "q string, doc long, score double")
    assert rk.margin_prune(flat).count() == 4
    assert {round(r.norm, 3) for r in rk.normalise(flat, by=["q"]).collect()} == {0.5}
    spread = spark.createDataFrame([("q", i, float(i)) for i in range(11)], "q string, doc long, score double")
    assert sorted(r.doc for r in rk.margin_prune(spread).collect()) == [6, 7, 8, 9, 10]
    fused = {r.doc: (r.score, r.match) for r in rk.fuse(spark.createDataFrame([("q", 1, 2.0), ("q", 2, 1.0)], "q string, doc long, score double"), spark.createDataFrame([("q", 1, 0.5)], "q string, doc long, score double")).collect()}
    assert fused == {1: (1.0, "hybrid"), 2: (0.25, "lexical")}


def test_next_event_ties(spark):
    left = spark.createDataFrame([("k", 10, "a"), ("k", 20, "b"), ("m", 5, "c")], "k string, t long, name string")
    right = spark.createDataFrame([("k", 10, 1), ("k", 30, 2)], "k string, at long, v long")
    got = {r.name: (r.next_time, r.next_value) for r in tb.next_event(left, right, ["k"], "t", "at", "v").collect()}
    assert got == {"a": (10, 1), "b": (30, 2), "c": (None, None)}
    strict = {r.name: r.next_time for r in tb.next_event(left, right, ["k"], "t", "at", "v", strict=True).collect()}
    assert strict == {"a": 30, "b": 30, "c": None}

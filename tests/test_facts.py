"""Facts that are absorbed, by hand and against a plain version; acronyms by hand."""

import random
import time

from pyspark.sql import functions as F

from evispark.operators import acronyms as ac
from evispark.operators import facts as fc

SCHEMA = "p string, t timestamp, i long, text string, attr string, val string, one boolean, old boolean"


def log_of(spark, rows):
    frame = spark.createDataFrame(rows, "p string, t long, i long, text string, attr string, val string, one boolean, old boolean").withColumn("t", F.timestamp_seconds("t"))
    log = fc.absorb(frame.repartition(3), "p", "t", "i", "text", attribute="attr", value="val", single="one", stored="old")
    return {r.i: (r.outcome, r.fact, r.content) for r in log.collect()}, {(r.p, r.fact): (r.content, r.changes) for r in fc.facts_after(log, frame, "p", "t", "i").collect()}


def test_rules(spark):
    rows = [
        ("a", 1, 1, "My dog is Toby", None, None, False, True),
        ("a", 2, 2, "my dog is Toby, and brown!", None, None, False, False),
        ("a", 3, 3, "my dog is toby", None, None, False, False),
        ("b", 3, 4, "my dog is Toby", None, None, False, False),
        ("a", 4, 5, "I live in León", "home", "León", True, False),
        ("a", 5, 6, "moro em leon", "home", "leon", True, False),
        ("a", 6, 7, "my house is now in Vigo, Spain", "home", "Vigo", True, False),
        ("a", 7, 8, "likes chess a lot", "hobby", "chess", False, False),
        ("a", 8, 9, "runs on Sundays", "hobby", "runs", False, False),
        ("a", 9, 10, None, None, None, False, False),
        ("a", 9, 11, "un año", None, None, False, False),
        ("a", 9, 12, "un ano", None, None, False, False),
    ]
    log, left = log_of(spark, rows)
    assert log == {
        1: ("stored", 1, "My dog is Toby"), 2: ("merged", 1, "my dog is Toby, and brown!"), 3: ("merged", 1, "my dog is Toby, and brown!"), 4: ("added", 4, "my dog is Toby"), 5: ("added", 5, "I live in León"),
        6: ("merged", 5, "moro em leon"), 7: ("replaced", 5, "my house is now in Vigo, Spain"), 8: ("added", 8, "likes chess a lot"), 9: ("merged", 8, "runs on Sundays"), 10: ("added", 10, ""), 11: ("added", 11, "un año"), 12: ("added", 12, "un ano"),
    }
    assert left[("a", 1)] == ("my dog is Toby, and brown!", 2) and left[("a", 5)] == ("my house is now in Vigo, Spain", 2) and left[("b", 4)] == ("my dog is Toby", 0)


def test_stored_facts_and_later_ones_in_two_steps(spark):
    rng = random.Random(5)
    words = "red blue green old new house car dog cat big small".split()
    rows = [("p", k, k, " ".join(rng.sample(words, rng.randint(1, 4))), rng.choice([None, "x", "y"]), rng.choice(words), rng.random() < 0.5, False) for k in range(200)]
    whole_log, whole = log_of(spark, rows)
    assert {o for o, _, _ in whole_log.values()} == {"added", "merged", "replaced"}
    # every fact that is left stands as its last change says
    for (_, fact), (content, changes) in whole.items():
        mine = [(i, c) for i, (_, f, c) in whole_log.items() if f == fact]
        assert max(mine)[1] == content and len(mine) == changes + 1 and min(mine)[0] == fact


def test_acronym_pairs(spark):
    texts = [
        "Empieza la reanimación cardiopulmonar (RCP). Otra que busque un desfibrilador (DEA) ya. DEA (desfibrilador externo automático)",
        "En 1990 (ABC) y fema.gov (GOV) (see RCP) IV (cuatro de ellos) XL (no 7 digits)", None, "", "x (ABCDEFG) y (A) <!-- oculto mismo (OM) --> the World Health Organization (WHO), world health organization (WHO)",
        "one two three four five six seven eight (OTT)", "WHO (World Health\nOrganization) UN (solo) see chapters (SC)",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", ac.acronym_pairs(F.col("text")).alias("p")).collect()
    got = {r.id: [tuple(p) for p in r.p] for r in rows}
    assert got == {
        0: [("RCP", "reanimación cardiopulmonar"), ("DEA", "desfibrilador"), ("DEA", "desfibrilador externo automático")], 1: [], 2: [], 3: [], 4: [("WHO", "World Health Organization")],
        5: [("OTT", "three four five six seven eight")], 6: [("WHO", "World Health Organization")],
    }


def test_acronyms_of_long_runs(spark):
    # one run of letters and one of words, without a bracket: each place of them was a start that looked at all that follows
    texts = ["a" * 300_000 + " (AB", "word " * 60_000 + "(AB", "x" * 300_000 + " (XY)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    began = time.monotonic()
    assert [tuple(r) for r in rows.select("id", F.size(ac.acronym_pairs(F.col("text")))).orderBy("id").collect()] == [(0, 0), (1, 0), (2, 0)]
    assert time.monotonic() - began < 20


def test_mined_acronyms_and_ties(spark):
    texts = ["health world (WH)", "World Health (WH)", "world health (WH)", "one half (WH)", "Wide Hall (WH)"]
    found = ac.mined_acronyms(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").orderBy("rank").collect()
    assert [(r.definition, r.n_texts, r.example, r.spelled) for r in found] == [("World Health", 2, 1, True), ("Wide Hall", 1, 4, True), ("health world", 1, 0, False), ("one half", 1, 3, False)]

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import ranking as rk

STARTS = re.compile(r"[0-9]")


def singulars(t):
    if len(t) < 4 or not t.endswith("s") or re.search("(ss|is|us)$", t):
        return []
    if t.endswith("ies"):
        return [t[:-3] + "y"]
    return [t[:-1], t[:-2]] if re.search("(s|x|z|o|ch|sh)es$", t) else [t[:-1]]


def content(text, most=12):
    seen, out = set(), []
    for t in text.lower().split():
        forms = [t, *singulars(t)]
        if len(t) < 2 or t in rk.STOP_WORDS or seen & set(forms):
            continue
        seen |= set(forms)
        out.append((t, forms, t[: max(4, len(t) - 2)] if len(t) >= 5 and not STARTS.search(t) else None))
        if len(out) == most:
            break
    return out


QUESTIONS = [
    (1, "what is the cause of the storm in the north and how do the rivers of the valley rise to the bridge when it rains"),
    (2, "boxes box cities city viruses glass abc12"),
    (3, "what is the"),
    (4, " ".join(f"w{i}" for i in range(20))),
    (5, "storms storm"),
]
DOCS = [(1, "a storm near the northern bridge and a river"), (2, "the cause of it"), (3, "one box and one city with a virus"), (4, "w0 w1 w2 w3 w4 w5 w6 w12 w13"), (5, "bridges rained valleys rivers risen"), (6, None), (7, "storming storm storms")]


def test_content_terms(spark):
    got = rk.content_terms(spark.createDataFrame(QUESTIONS, "q long, t string"), "q", "t").collect()
    want = {(q, t, k) for q, text in QUESTIONS for t, forms, start in content(text) for k in [f"={f}" for f in forms] + ([f"^{start}"] if start else [])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    # content words after the twelfth token are searched, stop words are not
    assert {"storm", "rivers", "bridge", "rains"} <= {t for q, t, _ in want if q == 1} and not {t for q, t, _ in want} & rk.STOP_WORDS
    assert len({t for q, t, _ in want if q == 4}) == 12


def test_bm25_content(spark):
    terms = rk.content_terms(spark.createDataFrame(QUESTIONS, "q long, t string"), "q", "t")
    scored = rk.bm25_content(spark.createDataFrame(DOCS, "d long, t string"), terms, "d", "t").cache()
    words = {d: (t or "").split() for d, t in DOCS}
    average = sum(map(len, words.values())) / len(words)
    hit = {k: {d: n for d, w in words.items() if (n := sum(x == k[1:] if k[0] == "=" else x.startswith(k[1:]) for x in w))} for k in {r.key for r in terms.collect()}}
    want = {}
    for q, text in QUESTIONS:
        score, matched = Counter(), {}
        for t, forms, start in content(text):
            for k in [f"={f}" for f in forms] + ([f"^{start}"] if start else []):
                for d, tf in hit[k].items():
                    df = len(hit[k])
                    score[d] += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[d]) / average))
                    matched.setdefault(d, set()).add(t)
        want |= {(q, d): (round(score[d], 9), len(matched[d])) for d in score}
    assert {(r.q, r.doc): (round(r.score, 9), r.matched) for r in scored.collect()} == want
    assert want[2, 3][1] == 3  # boxes, cities and viruses by their singulars
    kept = rk.coverage_gate(scored, terms.select("q", "term").distinct())
    need = {q: len(c) if len(c := content(t)) <= 2 else math.ceil(len(c) / 2) for q, t in QUESTIONS}
    assert {(r.q, r.doc) for r in kept.collect()} == {(q, d) for (q, d), (_, n) in want.items() if n >= need[q]}


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_dealt_out_once_by_document(spark):
    terms = rk.content_terms(spark.createDataFrame(QUESTIONS, "q long, t string"), "q", "t")
    docs = spark.createDataFrame([(d, t, "ab"[d % 2]) for d, t in DOCS], "d long, t string, c string")
    for corpus in (None, F.col("c")):
        plan = planned(rk.bm25_content(docs, terms, "d", "t", corpus=corpus))
        dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
        # whatever has a document is dealt out by it alone, and no filter cuts up a text before it is cut up
        assert {re.sub(r"#\d+L?", "", x) for x in dealt if "doc#" in x} == {"corpus, doc" if corpus is not None else "doc"}
        assert "Cartesian" not in plan and not re.search(r"Filter \(size\(array_remove", plan)
    # a document's rows of one length are one, those of another length are weighed apart
    twice = rk.bm25_content(spark.createDataFrame([(1, "storm x"), (1, "storm y"), (1, "storm"), (2, "calm")], "d long, t string"), rk.exact_keys(spark.createDataFrame([(7, "storm")], "q long, term string")), "d", "t")
    weigh = lambda tf, n: math.log(1 + (4 - 2 + 0.5) / 2.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.5))
    assert [(r.q, r.doc, round(r.score, 9), r.matched) for r in twice.collect()] == [(7, 1, round(weigh(2, 2) + weigh(1, 1), 9), 1)]


def test_documents_leave_the_scan_once_with_counted_keys(spark, monkeypatch):
    terms = rk.content_terms(spark.createDataFrame(QUESTIONS, "q long, t string"), "q", "t")
    docs = spark.createDataFrame([(d, t, "ab"[d % 2]) for d, t in [*DOCS, (8, ""), (9, " -- "), (10, "STÓRM  the storming, storm'storms")]], "d long, t string, c string")
    for corpus in (None, F.coalesce("c", F.lit(""))):
        plan = rk.bm25_content(docs, terms, "d", "t", corpus=corpus)
        # lengths, document frequencies and scores read one shuffle of one row a document: no filter sets one of its readers apart
        lines = planned(plan).splitlines()
        below = [lines[i + 1] for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line]
        assert len(below) == 3 and all("MapInArrow" in line for line in below)
        counted = sorted(tuple(r) for r in plan.collect())
        body = sorted(tuple(r) for r in rk.field_weighted_tf(docs, terms, "d", "c", "t").collect())
        with monkeypatch.context() as m:
            m.setattr(rk, "_listed", lambda keys: None)  # keys too many for a broadcast
            joined = sorted(tuple(r) for r in rk.bm25_content(docs, terms, "d", "t", corpus=corpus).collect())
            assert body == sorted(tuple(r) for r in rk.field_weighted_tf(docs, terms, "d", "c", "t").collect())
        near = lambda rows: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
        assert near(counted) == near(joined) and len(counted) > 5
    rows = {r.d: (r.doc_len, r.hits) for r in rk.counted_keys(docs.select("d", "t"), "t", ["=storm", "^stor", "=x"]).collect()}
    assert rows == {**{d: (len((t or "").split()), []) for d, t in DOCS}, 1: (9, [1, (1 << 32) + 1]), 7: (3, [1, (1 << 32) + 3]), 8: (0, []), 9: (0, []), 10: (5, [2, (1 << 32) + 4])}


def test_hint_and_clauses_read_a_text_once(spark):
    docs = spark.createDataFrame([(1, "the cat is in the house and it was here, \t if\nyou WHILE it rained  . x")], "d long, t string")
    found = docs.select(tx.language_hint(tx.tokens(F.col("t"))).alias("hint"), tx.clauses(F.col("t")).alias("c"))
    assert planned(docs.select(tx.language_hint(tx.tokens(F.col("t"))).alias("h"))).count("split(") == 1
    assert [tuple(c) for c in found.first().c] == [("the cat is in the house", False), ("it was here", False), ("it rained", True)] and found.first().hint == "en"


def test_fusion_asks_for_the_coverage_of_the_best_alone(spark, monkeypatch):
    from evispark.plans import registry

    seen = []
    monkeypatch.setattr(rk, "absolute_gate", lambda fused, coverage, floor, own: seen.append(coverage) or fused)
    registry.QUERIES["h_fusion"](spark, "/root/testdata/sf0.001")
    assert seen[0].groupBy("q").count().agg(F.max("count")).first()[0] <= 50  # not of every hit

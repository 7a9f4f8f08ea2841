import math
import random
import re
from collections import Counter

from evispark.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w, k=5):
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def brute(docs, items, percent=80):
    """All (doc, item) with an item-sized window at or above the similarity: every window against every item."""
    bag = {i: Counter(shingles(words(t))) for i, t in items if words(t)}
    df = Counter(s for b in bag.values() for s in b)
    weight = lambda s: math.log(1 + len(bag) / df.get(s, 1))
    found = set()
    for d, text in docs:
        w = words(text)
        for i, t in items:
            n = len(words(t))
            if not n or not w:
                continue
            for start in range(max(1, len(w) - n + 1)):
                window = Counter(shingles(w[start : start + n]))
                low = sum(weight(s) * min(c, window[s]) for s, c in bag[i].items())
                high = sum(weight(s) * max(bag[i][s], window[s]) for s in bag[i] | window)
                if low / high >= percent / 100 - 1e-12:
                    found.add((d, i))
                    break
    return found


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([3, 14, 30, 59]))) for i in range(25)]
    docs = []
    for d in range(120):
        body = text(rng.randint(0, 150))
        if rng.random() < 0.6:
            leak = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.choice([0, -1, rng.randrange(len(leak))])] = "changed"
            if rng.random() < 0.2:
                leak.insert(rng.randrange(len(leak)), "inserted")
            at = rng.randint(0, len(body))
            body[at:at] = leak
        docs.append((d, ", ".join(body).title()))
    return docs, [(i, " ".join(t)) for i, t in items]


def test_equals_brute_force(spark):
    docs, items = sample(4)
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    want = brute(docs, items)
    assert want and found == want


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = random.Random(1)
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        assert any(((a ^ b) >> at & ((1 << width) - 1)).bit_count() <= 2 for at, width in decontaminate.BLOCKS)
    assert sum(w for _, w in decontaminate.BLOCKS) == 64


def test_edges_and_clean_documents_stay(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "  "), (None, "x y z"), (4, "tiny"), (1, "one two three four five six seven")], "item_id long, text string")
    rows = [(1, "ONE two, three four five six: seven!", "a"), (2, None, "a"), (3, "", "a"), (None, "one two three four five six seven", "a"), (5, "one two three", "a"), (6, "tiny words", "a"), (7, "nothing of that", "a"), (1, "ONE two, three four five six: seven!", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1), (6, 4)}
    left = decontaminate.drop_leaked(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {2, 3, None, 5, 7}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items, nothing = spark.createDataFrame([(1, "a b c")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(none, items).collect() == []
    assert decontaminate.leaks(some, nothing).collect() == []


def test_words_put_in_and_taken_out(spark):
    """Items that are broken up inside, with shingles of very different weight: all windows against all items, many seeds."""
    docs, items = [], []
    for seed in range(2):
        rng = random.Random(100 + seed)
        vocabulary = [f"w{seed}x{i}" for i in range(300)]
        common = [rng.choice(vocabulary) for _ in range(12)]  # shared by most items: light shingles
        own = [[*common, *(rng.choice(vocabulary) for _ in range(rng.choice([20, 45])))] for _ in range(6)]
        items += [(100 * seed + i, " ".join(t)) for i, t in enumerate(own)]
        for d in range(25):
            leak = list(rng.choice(own))
            for _ in range(rng.choice([1, 1, 2, 3])):
                at = rng.randrange(len(leak))
                if rng.random() < 0.5:
                    leak[at:at] = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4]))]
                else:
                    del leak[at : at + rng.choice([1, 2])]
            before = [rng.choice(vocabulary) for _ in range(12)]
            docs.append((1000 * seed + d, " ".join([*before, *leak, *reversed(before)])))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert len(want) >= 9 and {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_very_long_text_and_clashing_columns(spark):
    item = " ".join(f"part{i}" for i in range(20))
    rows = [(1, "filler words of no kind at all " * 6_000 + item, 7, 1, 1, "x"), (2, "clean", 7, 1, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, start int, h int, gone string")
    items = spark.createDataFrame([(5, item, 1, 1)], "item_id long, text string, words int, df int")
    assert [(r.doc_id, r.item_id, r.start) for r in decontaminate.leaks(docs, items).collect()] == [(1, 5, 7 * 6_000)]
    assert [tuple(r) for r in decontaminate.drop_leaked(docs, items).collect()] == [rows[1]]

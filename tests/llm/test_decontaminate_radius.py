import random

import pytest

from test_decontaminate import brute

from evispark.llm import decontaminate


@pytest.mark.parametrize("seed", range(3))
def test_leaks_cut_short_just_over_the_threshold(spark, seed):
    """Items whose last words are others in the document: similarity (s - m) / (s + m) over s shingles, 0.80 to 0.84."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    items, docs = [], []
    for i, (n, changed) in enumerate([(59, 6), (50, 5), (40, 4), (59, 5), (50, 4), (25, 2), (13, 1)] * 30):
        words = text(n)
        items.append((i, " ".join(words)))
        kept = words[:-changed] + text(changed) if rng.random() < 0.5 else text(changed) + words[changed:]
        docs.append((i, " ".join(text(20) + kept + text(20))))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items}
    assert all(0.8 - 1e-9 <= r.similarity <= 0.85 for r in got)


def test_seeds_find_what_all_windows_find(spark):
    """Leaks with changes at the ends, inside, put in and taken out, around the bound: every window of every length against every item, over many seeds."""

    docs, items, want = [], [], set()
    for seed in range(8):
        rng = random.Random(500 + seed)
        vocabulary = [f"s{seed}w{i}" for i in range(200)]
        own = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 13, 25, 40, 59]))] for _ in range(6)]
        mine = [(100 * seed + i, " ".join(t)) for i, t in enumerate(own)]
        texts = []
        for d in range(30):
            leak = list(rng.choice(own))
            for _ in range(max(1, len(leak) // rng.choice([8, 10, 14, 20]))):
                kind, at = rng.choice("aabcd"), rng.randrange(len(leak))
                if kind == "a":
                    leak[rng.choice([0, -1])] = rng.choice(vocabulary)
                elif kind == "b":
                    leak[at] = rng.choice(vocabulary)
                elif kind == "c":
                    leak.insert(at, rng.choice(vocabulary))
                elif len(leak) > 3:
                    del leak[at]
            before = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
            texts.append((1000 * seed + d, " ".join([*before, *leak, *reversed(before)])))
        docs, items = docs + texts, items + mine
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 50 and got <= want and len(want - got) <= 0.01 * len(want), (len(want), want - got)

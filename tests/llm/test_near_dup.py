import random
import re

import pytest

from evispark.llm import near_dup


def brute(rows, k, percent):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, groups, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    rows, at = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((at, rng.choice([" ", "\n", " \t"]).join(copy)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = corpus(k, 60, 3)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k, percent=percent).collect()
    want = brute(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group spread around the threshold, larger than a block: the rest of step 4 must find what stars miss."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        copy = list(base)
        for j in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_edges(spark):
    rows = [(5, None, "x"), (4, "", "x"), (3, " \n", "x"), (2, "One", "x"), (9, "one", "y"), (None, "one", "z"), (8, "a b", "y"), (7, "A\tB", "y"), (7, "A\tB", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == {(5, 0, 5, True), (4, 0, 4, True), (3, 0, 3, True), (2, 1, 2, True), (9, 1, 2, False), (None, 1, None, True), (8, 1, 7, False), (7, 1, 7, True)}
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "5", "7", "7", "None"]


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bands_miss_less_than_one_in_a_million():
    for percent in (80, 85, 95):
        assert (1 - (percent / 100) ** near_dup.BAND_ROWS) ** near_dup.bands_for(percent) <= 1e-6

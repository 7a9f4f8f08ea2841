import random

import numpy as np

from evispark.llm import line_dedup


def brute(rows, percent=80):
    """doc_id -> sorted numbers of the lines that an earlier similar line removes."""
    lines = []
    for doc_id, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            tokens = frozenset("".join(c.lower() if "A" <= c <= "Z" else c for c in line).split(" ")) - {""}
            if tokens:
                lines.append((doc_id, n, tokens))
    lines.sort(key=lambda x: x[:2])
    gone: dict = {d: [] for d, _, _ in lines}
    for i, (d, n, a) in enumerate(lines):
        if any(100 * len(a & b) >= percent * len(a | b) for _, _, b in lines[:i]):
            gone[d].append(n)
    return gone


def corpus(seed, docs):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "é", "of"] * 20
    pool = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(pool)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line))
            if rng.random() < 0.2:
                text.append("")
        rows.append((i, "\n".join(text)))
    return rows


def decisions(spark, rows, **kw):
    got = line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()
    return {r.doc_id: r.removed_lines for r in got}


def test_equals_brute_force(spark):
    rows = corpus(1, 120)
    assert decisions(spark, rows) == brute(rows)


def test_long_lists_equal_brute_force(spark):
    """Templated lines: one word pair shared by all of them, so that its lists are long."""
    rng = random.Random(2)
    rows = [(i, "\n".join(f"entry number {rng.randrange(60)} is {'very ' * rng.randint(0, 1)}done {rng.randrange(9)} times now" for _ in range(3))) for i in range(60)]
    assert decisions(spark, rows) == brute(rows)


def test_lists_cut_into_blocks_equal_brute_force(spark, monkeypatch):
    """With blocks of 16 postings every common token's list is cut; decisions and links stay the same."""
    rows = corpus(4, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(line_dedup.line_decisions(docs).collect())
    monkeypatch.setattr(line_dedup, "LIST_ROWS", 16)
    cut = sorted(line_dedup.line_decisions(docs).collect())
    assert cut == whole
    assert {r.doc_id: r.removed_lines for r in cut} == brute(rows)


def test_links_count_every_pair_of_different_sets_once(spark):
    """A group of near copies: each of 40 differs from the others in one word, all pairs are similar."""
    rows = [(i, " ".join(f"w{k}" for k in range(20)) + f" own{i}") for i in range(40)] + [(99, "own3 " + " ".join(f"W{k}" for k in range(20)))]
    got = {r.doc_id: r.n_links for r in line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(40)}, 99: 3}


def test_pairs_pass_all_filters_that_brute_force_needs():
    """No qualifying pair is lost by the prefix, length and positional filters, whatever the token order."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(150):
        base = rng.choice(60, rng.integers(1, 20), replace=False)
        sets += [base, np.unique(np.append(base[: max(1, len(base) - 1)], rng.integers(60)))]
    sets = [np.unique(s) for s in sets]
    token, n, pos, cls, bitmap = [], [], [], [], []
    for c, s in enumerate(sets):
        bits = np.bitwise_xor.reduce(np.uint64(1) << (s.astype(np.uint64) * np.uint64(7) % np.uint64(64)))
        for p in range(int(line_dedup._prefix(np.array(len(s)), 80))):
            token.append(s[p]), n.append(len(s)), pos.append(p), cls.append(c), bitmap.append(bits)
    order = np.lexsort((pos, n, token))
    columns = [np.array(x)[order] for x in (token, n, pos, cls, bitmap)]
    found = {tuple(sorted((int(columns[3][i]), int(columns[3][j])))) for a, b in line_dedup._pairs_in(*columns, 80) for i, j in zip(a, b, strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                assert (b, a) in found


def test_drop_and_edges(spark):
    rows = [(1, "a b c d e\n\nx", "k"), (2, "a b c d e\nnew words here", "k"), (3, "A B C D E", "k"), (4, None, "k"), (5, "", "k"), (None, "a b c d e", "k"), (6, " \n\t", "k"), (7, "x\nx", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == {(1, "a b c d e\n\nx", "k"), (2, "new words here", "k"), (4, None, "k"), (5, "", "k"), (None, "a b c d e", "k"), (6, " \n\t", "k")}


def test_repeated_rows_get_the_same_decision(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c")]
    assert decisions(spark, rows) == {1: [], 2: [0]}


def test_empty_table(spark):
    assert decisions(spark, []) == {}


def test_very_long_line(spark):
    long = " ".join(f"t{i}" for i in range(40_000))
    assert decisions(spark, [(1, long), (2, long + " more"), (3, "t1 t2")]) == {1: [], 2: [0], 3: []}

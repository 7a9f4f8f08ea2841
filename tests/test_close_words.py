import random

import pytest

from evispark.operators import entities as en


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *_next(row, i, x, b)]
    return row[-1]


def _next(row, i, x, b):
    out, left = [], i
    for j, y in enumerate(b):
        left = min(row[j + 1] + 1, left + 1, row[j] + (x != y))
        out.append(left)
    return out


@pytest.mark.parametrize("most, head", [(1, 0), (2, 0), (2, 2)])
def test_equals_all_pairs(spark, most, head):
    rng = random.Random(most + head)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    got = {(r.a, r.b): r.distance for r in en.close_words(spark.createDataFrame([(w,) for w in words], "w string"), "w", most=most, head=head).collect()}
    want = {(a, b): d for a in words for b in words if a < b and a[:head] == b[:head] and (d := distance(a, b)) <= most}
    assert got == want

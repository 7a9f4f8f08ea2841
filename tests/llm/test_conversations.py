"""Conversation repair: against SQL, and against a search over all edits that knows no states."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import duckdb
import pytest

from evispark.llm import conversation_sql, conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, cost string, at int"
SOUND = re.compile(r"(s?(ua)+)?\Z")


def grows(initials):
    """Whether more turns can make a sound conversation of these."""
    return any(SOUND.match(initials + rest) for rest in ("", "a", "ua"))


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, turns): the cheapest first, then the least audit, by a search over (turns read, turns made)."""
    faults = plain_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, made = heappop(heap)
        if at == len(rows) and SOUND.match(initials):
            return cost, audit, list(made)
        key = (at, initials[-1:], initials in ("", "s"))  # what may follow depends on the last turn only
        if key in done:
            continue
        done.add(key)
        moves = [(2, "I", 0, "user", ""), (2, "I", 0, "assistant", "")]
        if at < len(rows):
            _, role, text = rows[at]
            moves.append((3, "D", 1, None, None))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                moves += [(more, "K", 1, role, text), (2 + more, "R", 1, "user", text), (2 + more, "R", 1, "assistant", text)]
        for add, letter, step, role, text in moves:
            if role is None:
                heappush(heap, (cost + add, audit + letter, at + step, initials, made))
            elif grows(initials + role[:1]) and role[:1] in ("s", "u", "a"):
                heappush(heap, (cost + add, audit + letter, at + step, initials + role[:1], (*made, (role, text))))
    raise AssertionError


def plain_damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        show = lambda v: " " if v is None else str(v)
        role, text, h = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        here = out.setdefault(conv, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        here += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain(rows):
    out = {}
    for conv, turns in plain_damage(rows).items():
        faults, numbers = plain_faults(turns), {t[0] for t in turns if t[0] is not None}
        cost, audit, made = plain_repair(turns)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def made_up(seed, conversations_=120):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "sys"]
    texts = ["Yes.", "No", "Why?", " ", "", None, "So it is!\n", "é…", "a.b", "Well. ", "\t\x0b"]
    rows = []
    for conv in [None, *range(conversations_)]:
        sound = rng.random() < 0.4
        for k in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            turn = rng.choice([k, k, k, k, k + rng.randrange(3), None])
            role = ("user", "assistant")[k % 2] if sound else rng.choice(roles)
            rows.append((conv, turn, role, f"{rng.choice(['w', 'x'])}{rng.choice(texts) or ''}" if sound else rng.choice(texts), "k", 7))
    return rows


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_search_over_edits(spark, tmp_path, seed):
    rows = made_up(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain(rows)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = duck.sql(conversation_sql.SQL)
    assert {r[0]: r[1:] for r in found.fetchall()} == got and tuple(found.columns[1:]) == NAMES


def test_table_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = sorted(duck.sql(conversation_sql.SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op13_conversation_repair(spark, "/root/testdata/sf0.01").collect()) == want


def test_turns_that_keep_their_texts(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hm?"), (1, 2, "user", "Well?"), (1, 3, "assistant", "No."), (2, 0, "assistant", "Hi.")]
    found = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (found[1].cost, found[1].audit) == (2, "KKIKK")
    assert [tuple(t) for t in found[1].repaired] == [("system", "Be brief."), ("user", "Hm?"), ("assistant", ""), ("user", "Well?"), ("assistant", "No.")]
    assert (found[2].cost, found[2].audit) == (2, "IK")


def test_no_turns_left_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x", False), (1, 1, None, None, None)], "conv_id long, turn long, role string, text string, here boolean")
    [r] = conversations.repair(rows, "here").collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", [])
    assert conversations.repair(rows.limit(0)).collect() == []


def test_a_long_conversation_and_long_texts(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"{k} " + "word " * (40_000 if k == 5 else 3) + ".") for k in range(3000) if k != 1000]
    [r] = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert (r.gaps, r.illegal, r.cost, len(r.repaired)) == (1, 1, 2, 3000) and r.audit == "K" * 1000 + "I" + "K" * 1999

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import entities as en
from evispark.operators import ranking as rk
from evispark.sources import text_tables as st

FILES = {
    "a.pdf": (b"%PDF-1.7 x", "pdf"), "b": (b"\xff\xd8\xff\xe0", "image"), "c.png": (b"\x89PNG\r\n\x1a\nabc", "image"), "d.webp": (b"RIFF1234WEBPx", "image"), "e": (b"GIF89a..", "image"),
    "f.bmp": (b"BM12", "image"), "g.txt": (b"BM12", "text"), "h.heic": (b"\x00\x00\x00\x18ftypheicx", "image"), "i.xlsx": (b"PK\x03\x04..", "unsupported:spreadsheet"), "j.docx": (b"PK\x03\x04..", "unsupported:archive"),
    "k.doc": (b"\xd0\xcf\x11\xe0..", "unsupported:old-office"), "l.md": (b"\x00\x01", "text"), "m": (b"plain \xc3\xb1 text", "text"), "n": (b"\x00\x01\x02", "unsupported:unknown"), "o": (b"\xff\xfe\x00", "unsupported:unknown"),
}


def test_file_kinds(spark, tmp_path):
    for name, (content, _) in FILES.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in st.read_files(spark, str(tmp_path)).collect()}
    assert got == {name: kind for name, (_, kind) in FILES.items()}


ROWS = [(1, 'say "hi", you', ["a", "b"], None), (2, "two\nlines", [], 1.5), (3, None, None, -2.0), (4, "plain", ["x"], 0.1)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, text string, marks array<string>, x double")
    st.write_csv(df, str(tmp_path / "csv"), order=[F.col("id")])
    back = spark.read.option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "csv"), schema="id long, text string, marks string, x double")
    assert sorted(map(tuple, back.collect())) == [(i, t, "|".join(m) if m else None, x) for i, t, m, x in ROWS]


def test_two_sections(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a,")], "id long, t string")
    lines = st.csv_lines(df, [F.col("id")]).unionByName(st.csv_lines(df.where("id = 2"), [F.col("id")], 1, "rejections")).unionByName(st.csv_lines(df.limit(0), [F.col("id")], 2, "none"))
    text = [r.line for r in lines.orderBy("section", "n").collect()]
    assert text == ["id,t", '1,"a,"', "2,b", "", "# rejections", "id,t", "2,b"]


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame(ROWS + [ROWS[3]], "id long, text string, marks array<string>, x double")
    st.write_jsonl(df, str(tmp_path / "rows"), ["x", "id"])
    lines = sorted(line for p in (tmp_path / "rows").glob("part-*") for line in p.read_text().splitlines())
    assert len(lines) == 5 and lines[-1] == '{"x":null,"id":1}'
    st.export_collection(df, str(tmp_path / "set"), ["id", "text"])
    assert len([line for p in (tmp_path / "set").glob("part-*") for line in p.read_text().splitlines()]) == 4


def test_log_reader(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(['12:01 [EVAL] {"run":"a","n":1}', '  {"run":"b","n":2}', '[EVAL] {"run":""}', "noise", '[EVAL] {"run":', json.dumps({"n": 3})]))
    schema = spark.createDataFrame([], "run string, n long").schema
    assert sorted(map(tuple, st.read_log_rows(spark, str(tmp_path / "log"), schema, ["run"]).collect())) == [("a", 1), ("b", 2)]


def pack(lines, most):
    out, now, size = [], [], 0
    for line in lines:
        piece = line[:most]
        if now and size + len(piece) + 1 > most:
            out, now, size = [*out, "\n".join(now)], [], 0
        now, size = [*now, piece], size + len(piece) + 1
    return [*out, "\n".join(now)] if now else out


def intro(text, target=600, most=3):
    done, now = [], ""
    for raw in (m[0] for p in text.split("\n") for m in re.finditer(r"""[^.!?]+(?:[.!?]+["')\]]*|$)\s*""", p)):
        s = raw.strip()
        if not s:
            continue
        if now and len(now) + 1 + len(s) > target:
            done, now = [*done, now], s
        else:
            now = f"{now} {s}" if now else s
    made = ([*done, now] if now else done)[:most]
    return [c for i, c in enumerate(made) if len(c) >= 40 or i == len(made) - 1]


def test_packing_and_intros_equal_plain_versions(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randrange(0, 12))) + rng.choice([".", "!", "", "?"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", tx.packed_lines(F.split("t", "\n"), 90).alias("p"), tx.intro_chunks(F.col("t"), 120, 3).alias("c")).collect()
    for r in rows:
        assert list(r.p) == pack(texts[r.i].split("\n"), 90)
        assert list(r.c) == intro(texts[r.i], 120, 3)


def test_results_without_copies(spark):
    rows = [(1, 1, 1, "T", "a b c d e"), (1, 2, 2, " t ", "A b c d x"), (1, 3, 3, "u", "a b c d e"), (1, 4, 4, "T", "q r s"), (1, 5, 5, "T", "r s"), (2, 1, 1, "T", "word"), (2, 2, 2, "T", "word")]
    kept = en.without_copies(spark.createDataFrame(rows, "q long, doc long, rank int, title string, body string")).collect()
    assert {(r.q, r.doc) for r in kept} == {(1, 1), (1, 3), (1, 4), (2, 1), (2, 2)}


def test_reserved_place(spark):
    rows = [(1, i, 1.0 - i / 100, f"t{i}", False) for i in range(10)] + [(1, 90, 0.80, "mine", True), (1, 91, 0.70, "mine", True), (2, 1, 0.9, "a", False), (2, 9, 0.3, "b", True)]
    fused = spark.createDataFrame(rows, "q long, doc long, score double, article string, own boolean")
    got = {(r.q, r.rank): r.doc for r in rk.reserve(fused, 3, F.col("article"), F.col("own")).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 90, (2, 1): 1, (2, 2): 9}
    far = fused.where("q = 1").withColumn("score", F.when(F.col("own"), 0.5).otherwise(F.col("score")))
    assert {r.doc for r in rk.reserve(far, 3, F.col("article"), F.col("own")).collect()} == {0, 1, 2}


@pytest.mark.parametrize("pool", [7, 8])
def test_absence_gate(spark, pool):
    """Three terms of which one is nowhere: with eight candidates and no telling match the corpus falls."""
    frame = spark.createDataFrame([(1, d) for d in range(pool)], "q long, doc long")
    matches = spark.createDataFrame([(1, d, "common") for d in range(pool)], "q long, doc long, term string")
    terms = spark.createDataFrame([(1, t) for t in ("common", "rare", "nowhere")], "q long, term string")
    assert rk.unfounded(frame, frame.limit(3), matches, terms).count() == (3 if pool < 8 else 0)
    told = matches.unionByName(spark.createDataFrame([(1, 0, "rare")], "q long, doc long, term string"))
    assert rk.unfounded(frame, frame.where("doc = 0"), told, terms).count() == 1


def plain_repetition(text):
    """The shortest unit that the text's end repeats, by building the repeats."""
    tail = text[-2000:]
    parts = text.split("```")
    if len(text) < 80 or len(parts) % 2 == 0 and not re.match(r"tool(\s|$)", parts[-1]):
        return None
    for unit in range(2, 161):
        word = tail[-unit:]
        copies = max(k for k in range(1, len(tail) // unit + 2) if k == 1 or tail.endswith(word * k))
        if (copies >= 4 and copies * unit >= 80 or copies >= 3 and unit >= 40) and "|" not in word and any(c.isalpha() for c in word):
            return len(text) - (copies - 1) * unit, unit, copies
    return None


def test_repetition_equals_a_plain_version(spark):
    rng = random.Random(8)
    texts = [None, "", "short", "x" * 100 + "| " * 60, "```\n" + "ab cd " * 40, "1234 " * 60, "```tool\n" + "ab cd " * 40, "```toolbox\n" + "ab cd " * 40, "```a``` " + "ab cd " * 40, "é" * 90, "ab" * 3000, "Start. " + "again and again, " * 9]
    for _ in range(150):
        unit = "".join(rng.choice("ab |1😀") for _ in range(rng.choice([1, 2, 3, 5, 20, 39, 40, 41, 160, 161])))
        texts.append("".join(rng.choice("ab c") for _ in range(rng.randrange(100))) + unit * rng.randrange(1, 40) + unit[: rng.randrange(3)])
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", tx.repetition(F.col("text")).alias("r")).collect()
    assert {r.id: r.r and tuple(r.r) for r in rows} == {i: t and plain_repetition(t) or None for i, t in enumerate(texts)}


def test_disclosed_paths(spark):
    cells = ['{"a": {"b": 1, "c": 2}, "l": [{"x": "é", "y": 0}, 3, {}], "n": null, "z": 1.5}', "[1]", "{", None, "{}", '{"a": 3, "l": {"x": 1}}', '{"a": {"b": {"d": [1, {"e": 2}]}}}']
    shown = lambda paths: [r.s for r in spark.createDataFrame(list(enumerate(cells)), "i int, t string").orderBy("i").select(tx.disclosed(F.col("t"), paths).alias("s")).collect()]
    assert shown(["a.b", "l[].x", "q.r", "n"]) == ['{"a":{"b":1},"l":[{"x":"é"},null,{}],"n":null}', None, None, None, "{}", "{}", '{"a":{"b":{"d":[1,{"e":2}]}}}']
    assert shown(["l[].x", "l[].y", "z"])[0] == '{"l":[{"x":"é","y":0},null,{}],"z":1.5}'
    assert shown([]) == [None] * len(cells)


def test_repetition_needs_no_loop_in_the_plan(spark):
    """Each unit and number of copies in a lambda function took seconds a thousand texts."""
    plan = spark.range(1).select(tx.repetition(F.col("id").cast("string")).alias("r"))._jdf.queryExecution().toString()
    assert "lambda" not in plan

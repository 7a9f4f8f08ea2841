"""Language identification against a plain version of the whole operator, on small tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import bytewords as bw
from evispark.llm import language as lg

SPACES = " \t\n\v\f\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    """(bytes before with three spaces, start, end) of the words of a text, and the words."""
    data = lower(text).encode()
    for c in SPACES:
        data = data.replace(c.encode(), b" ")
    padded, at, out = b"   " + data + b"   ", 0, []
    for w in data.split(b" "):
        if w:
            out.append((at + 3, at + 3 + len(w)))
        at += len(w) + 1
    return padded, out


def slots(text):
    """For each word: (kind, slot) of its features, and its script."""
    padded, spans = words(text)
    for a, b in spans:
        features = []
        for i in range(a, b + 1):
            for kind, order in enumerate((3, 4)):
                gram = int.from_bytes(padded[i - order + 1 : i + 1], "big")
                features.append((kind, (gram * 2654435761 % 2**32) >> 16))
        raw = np.frombuffer(padded[a:b], np.uint8)
        features.append((2, int(bw.hash_spans(raw, np.array([0]), np.array([b - a]))[0]) >> 48))
        script = 0
        for c in padded[a:b].decode():
            if c.isalpha():
                names = [n for n, low, high in lg.SCRIPTS if low <= ord(c) <= high] or ["other"]
                script = max(script, lg.SCRIPT_NAMES.index(names[0]) + 1)
        yield features, script


def plain(train, texts):
    languages = sorted({lang for _, lang in train})
    counts = [[dict() for _ in languages] for _ in range(3)]
    scripts = [[0] * len(languages) for _ in range(len(lg.SCRIPT_NAMES) + 1)]
    for text, lang in train:
        k = languages.index(lang)
        for features, script in slots(text or ""):
            scripts[script][k] += 1
            for kind, slot in features:
                counts[kind][k][slot] = counts[kind][k].get(slot, 0) + 1
    total = [[sum(c.values()) for c in kind] for kind in counts]
    log = lambda kind, k, slot: math.log((counts[kind][k].get(slot, 0) + lg.SMOOTHING) / (total[kind][k] + lg.SMOOTHING * 65536))
    used = [[n >= 0.01 * max(sum(row[k] for row in scripts[1:]), 1) for k, n in enumerate(row)] for row in scripts]
    out = []
    for text in texts:
        rows, letters = [], []
        for features, script in slots(text or ""):
            score = np.zeros(len(languages))
            for kind, slot in features if script else ():
                logs = np.array([log(kind, k, slot) for k in range(len(languages))])
                score += logs - logs.mean()
            if script and any(used[script]):
                score = np.where(used[script], score, score.min() - 1e3)
            rows.append(score)
            letters.append(script > 0)
        if not any(letters):
            out.append(("und", 0.0))
            continue
        best, back = rows[0], []
        for row in rows[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - lg.PENALTY
            back.append((stay, top))
            best = np.where(stay, best, best[top] - lg.PENALTY) + row
        label = [int(best.argmax())]
        for stay, top in reversed(back):
            label.append(label[-1] if stay[label[-1]] else top)
        votes = np.bincount([x for x, is_word in zip(reversed(label), letters, strict=True) if is_word], minlength=len(languages))
        out.append((languages[int(votes.argmax())], votes.max() / sum(letters)))
    return out


SAMPLES = {
    "en": "the of and to in that was his with they have this from which you were her would there their what said".split(),
    "es": "que los las una por con para como pero sus este ya todo esta entre cuando muy sin sobre también niño".split(),
    "el": "και της την του στην για που από είναι στο θα δεν με τις ένα στη αυτό".split(),
    "ru": "что как это она так все его только мне было вот меня еще нет тебя для них".split(),
}


def documents(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice([*SAMPLES, None])
        text = [rng.choice(SAMPLES[lang or rng.choice(list(SAMPLES))]) for _ in range(rng.randrange(0, 30))]
        if rng.random() < 0.3:
            text += [rng.choice(SAMPLES[rng.choice(list(SAMPLES))]) for _ in range(15)]
        if rng.random() < 0.2:
            text += ["12", "--", "Հայ", "中文"]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text) if rng.random() < 0.95 else None, lang))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_results_equal_a_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = documents(rng, 120)
    extra = ["Հայ", "ʃ", "ª º", "12 34", "", None, "…", "½ ² Ⅷ", "the και", "漢字", "ABC def", "a"]
    rows += [(1000 + i, t, None) for i, t in enumerate(extra)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = lg.train(frame, ~held)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lg.identify(frame, model, spans=False).collect()}
    train = [(t, lang) for i, t, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = plain(train, [t for _, t, _ in rows])
    assert {i: (lang, round(score, 6)) for i, (lang, score) in got.items()} == {r[0]: (w[0], round(w[1], 6)) for r, w in zip(rows, want, strict=True)}
    for t, (lang, score) in zip(extra, want[-len(extra) :], strict=True):
        assert (lang == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= score <= 1


def test_neighbours_in_a_batch_change_nothing(spark):
    model = lg.train(spark.createDataFrame([(i, " ".join(w), k) for i, (k, w) in enumerate(SAMPLES.items())], "doc_id long, text string, lang string"), F.lit(True))
    one = spark.createDataFrame([(1, "las sobre was")], "doc_id long, text string")
    two = spark.createDataFrame([(0, "και που"), (1, "las sobre was"), (2, "только")], "doc_id long, text string").coalesce(1)
    assert lg.identify(one, model).collect()[0] == lg.identify(two, model).where("doc_id = 1").collect()[0]


def test_edges(spark):
    """Clashing columns, repeated rows and ids, an empty table, no training row, a very long text, the sample's bound."""
    schema = "doc_id long, text string, lang string, n long, share double, rank int"
    rows = [(i % 7, "the of and", "en", 1, 0.5, 1) for i in range(50)] + [(9, "que los las", "es", 1, 0.5, 1)] * 2 + [(None, "was his", "en", 1, 0.5, 1)]
    frame = spark.createDataFrame(rows, schema)
    model = lg.train(frame, F.lit(True), per_language=3)
    found = lg.identify(frame, model).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found} == {"en", "es"}
    empty = frame.limit(0)
    assert lg.identify(empty, model).collect() == [] and lg.train(empty, F.lit(True)).languages == ()
    assert {(r.lang_pred, r.score) for r in lg.identify(frame, lg.train(empty, F.lit(True))).collect()} == {("und", 0.0)}
    long = spark.createDataFrame([(1, "que los las " * 200_000)], "doc_id long, text string")
    assert [(r.lang_pred, r.score, len(r.spans)) for r in lg.identify(long, model).collect()] == [("es", 1.0, 1)]

"""Language spans of mixed texts: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's score in a language is the sum, over its byte 3-grams and 4-grams (with the spaces around it) and the
word itself, of the log-odds against the mean of all languages, from counts hashed to fixed tables. A word's
script (by the code points of its letters) narrows the candidates to the languages whose training words
use that script; where none does, all stay. Viterbi labels each word so that the sum of scores, less PENALTY for
each switch, is greatest; words without a letter say nothing. A document's language is that of most of its
words with letters (ties: first in order), its score their share.

The model is learnt from at most PER_LANGUAGE documents of each language (those of least hash, whole texts);
its tables take 0.8 MB for each language. Null texts, and those without a Unicode letter, get `und`, score 0 and
no spans; any other text gets a learned language. Repeated rows give a row each; without any training row all is
`und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm import bytewords as bw

#: Documents of each language to learn from, at most; slots of each count table.
PER_LANGUAGE, TABLE_BITS = 1000, 16
PENALTY, SMOOTHING = 12.0, 0.5
UNDETERMINED = "und"
ORDERS = (3, 4)
#: First and last code point of script ranges; letters outside them are of script "other".
SCRIPTS = (
    ("latin", 0x0041, 0x02FF), ("latin", 0x1D00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xAB30, 0xAB6F), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0x2DE0, 0x2DFF), ("cyrillic", 0xA640, 0xA69F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x08A0, 0x08FF), ("arabic", 0xFB50, 0xFEFC),
    ("indic", 0x0900, 0x0DFF), ("thai", 0x0E00, 0x0EFF), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x139F), ("kana", 0x3040, 0x30FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7FF), ("han", 0x3400, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ("other",)


@lru_cache(1)
def _script_table() -> np.ndarray:
    """For each code point: 0 if it is no letter (of general category L), else its script's place in SCRIPT_NAMES plus 1."""
    table = np.full(0x110000, len(SCRIPT_NAMES), np.int8)
    for name, low, high in SCRIPTS:
        table[low : high + 1] = SCRIPT_NAMES.index(name) + 1
    table[~np.fromiter(map(str.isalpha, map(chr, range(len(table)))), bool, len(table))] = 0
    return table


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    tables: np.ndarray  # (kind of feature, slot, language): log-odds
    scripts: np.ndarray  # (script, language): whether the language's words use it


def _slots(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order: the slot of the n-gram that ends at each byte after a word's first (the space behind it too); each word's slot; the padded bytes."""
    clean = np.full(len(data) + 4, 32, np.uint32)
    body = clean[3:-1]
    body[:] = data
    body[bw.SPACE[data]] = 32
    code, grams = clean[3:].copy(), []
    for back in (1, 2, 3):
        code |= clean[3 - back : len(clean) - back] << np.uint32(8 * back)
        if back + 1 in ORDERS:
            grams.append(((code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64))
    return grams, (bw.hash_spans(data, start, end) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), clean


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes (A-Z lower-cased), each row with three spaces behind it, and their offsets: no n-gram spans two rows."""
    data, offsets = bw.text_bytes(column)
    rows = np.arange(len(offsets))
    out = np.full(len(data) + 3 * rows[-1], 32, np.uint8)
    out[np.arange(len(data)) + 3 * np.repeat(rows[:-1], np.diff(offsets))] = bw.LOWER[data]
    return out, offsets + 3 * rows


def _letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The script of each word: the last in SCRIPT_NAMES among its letters'; 0 without a letter."""
    table = _script_table()
    script = table[data & 0x7F]
    script[data > 0x7F] = 0
    for size, low, high, mask in ((2, 0xC2, 0xDF, 0x1F), (3, 0xE0, 0xEF, 0x0F), (4, 0xF0, 0xF4, 0x07)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + size <= len(data)]
        code = (data[at] & mask).astype(np.int32)
        for k in range(1, size):
            code = (code << 6) | (data[at + k] & 0x3F)
        script[at] = table[code]
    return np.maximum.reduceat(script, start) if len(start) else np.zeros(0, np.int8)


def _spread(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of rows[start:end] for each word (words don't overlap, ends <= the next start + 1)."""
    total = np.zeros((len(rows) + 1, rows.shape[1]), np.float64)
    np.cumsum(rows, axis=0, out=total[1:])
    return total[ends] - total[starts]


def emissions(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(word, language) scores; words without a letter have zeros."""
    out = np.zeros((len(start), len(model.languages)))
    for a in range(0, len(start), 1 << 16):  # bounds the rows of floats held at once
        s, e = start[a : a + (1 << 16)], end[a : a + (1 << 16)]
        low, high = max(0, s[0] - 3), e[-1] + 1  # with what n-grams see before and behind
        part = data[low:high]
        grams, word, _ = _slots(part, s - low, e - low)
        score = model.tables[len(ORDERS)][word]
        for k, g in enumerate(grams):
            score = score + _spread(model.tables[k][g], s - low, np.minimum(e - low + 1, len(g)))
        script = _letters(part, s - low, e - low)
        allowed = model.scripts[script]
        score = np.where(allowed | ~allowed.any(1)[:, None], score, score.min(1)[:, None] - 1e3)
        score[script == 0] = 0
        out[a : a + (1 << 16)] = score
    return out


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word; ``counts`` has the number of words of each text, whose words follow one another.

    All texts advance together: step t treats the t-th word of every text that has one.
    """
    labels = np.zeros(len(scores), np.int32)
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    if not len(length) or not length[0]:
        return labels
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
    best = scores[begin[: active[0]]].copy()
    back = []
    for t in range(1, int(length[0])):
        best = best[: active[t]]
        top = best.argmax(1)
        jump = best[np.arange(len(top)), top] - penalty
        stay = best >= jump[:, None]
        back.append((stay, top))
        best = np.where(stay, best, jump[:, None]) + scores[begin[: active[t]] + t]
        if t == length[0] - 1 or active[t + 1 if t + 1 < len(active) else t] < active[t]:
            gone = slice(active[t + 1] if t + 1 < len(active) else 0, active[t])
            labels[begin[gone] + t] = best[gone].argmax(1)
        if t == 1:
            gone = slice(active[1], active[0])
            labels[begin[gone]] = scores[begin[gone]].argmax(1)
    if length[0] == 1:
        labels[begin[: active[0]]] = best.argmax(1)
    for t in range(int(length[0]) - 1, 0, -1):
        stay, top = back[t - 1]
        n = active[t]
        now = labels[begin[:n] + t]
        labels[begin[:n] + t - 1] = np.where(stay[np.arange(n), now], now, top)
    return labels


def _predict(shared, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            for a, b in bw.slices(batch.column(1)):
                data, offsets = _padded(batch.column(1).slice(a, b - a))
                start, end, row = bw.spans(data, offsets)
                letters = _letters(data, start, end) > 0
                counts = np.bincount(row, minlength=b - a)
                if model.languages:
                    label = viterbi(emissions(model, data, start, end), counts)
                    votes = np.zeros((b - a, len(model.languages)), np.int64)
                    np.add.at(votes, (row[letters], label[letters]), 1)
                else:
                    label, votes = np.zeros(len(start), np.int32), np.zeros((b - a, 1), np.int64)
                total = votes.sum(1)
                pick = np.where(total > 0, votes.argmax(1), len(model.languages))
                share = np.where(total > 0, votes.max(1) / np.maximum(total, 1), 0.0)
                arrays, columns = [batch.column(0).slice(a, b - a), pa.array(names[pick], pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"]
                if spans:
                    first = np.append(True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])) if len(row) else np.zeros(0, bool)
                    at = np.flatnonzero(first & (total[row] > 0)) if len(row) else np.zeros(0, np.int64)
                    following = np.append(np.flatnonzero(first), len(row))
                    until = following[np.searchsorted(following, at, side="right")] if len(at) else at
                    base = np.cumsum(counts) - counts
                    size = np.bincount(row[at], minlength=b - a)
                    struct = pa.StructArray.from_arrays([pa.array((at - base[row[at]]).astype(np.int32)), pa.array((until - base[row[at]]).astype(np.int32)), pa.array(names[label[at]], pa.string())], ["first", "until", "lang"])
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), struct))
                    columns.append("spans")
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return run


def _tally(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, size = len(ORDERS) + 1, 1 << TABLE_BITS
        tables = np.zeros((kinds, size, len(languages)), np.int64)
        scripts = np.zeros((len(SCRIPT_NAMES) + 1, len(languages)), np.int64)
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for a, b in bw.slices(batch.column(0)):
                data, offsets = _padded(batch.column(0).slice(a, b - a))
                start, end, row = bw.spans(data, offsets)
                grams, word, _ = _slots(data, start, end)
                inside = np.zeros(len(data) + 2, np.int8)
                np.add.at(inside, start, 1)
                np.add.at(inside, end + 1, -1)
                inside = (np.cumsum(inside) > 0)[: len(data) + 1]
                at = np.flatnonzero(inside)
                of = lang[a:b][np.minimum(np.searchsorted(offsets, np.minimum(at, len(data) - 1), side="right") - 1, b - a - 1)]
                for k, g in enumerate(grams):
                    tables[k] += np.bincount(g[at] * len(languages) + of, minlength=size * len(languages)).reshape(size, -1)
                tables[-1] += np.bincount(word * len(languages) + lang[a:b][row], minlength=size * len(languages)).reshape(size, -1)
                scripts += np.bincount(_letters(data, start, end).astype(np.int64) * len(languages) + lang[a:b][row], minlength=scripts.size).reshape(scripts.shape)
        flat = np.concatenate([tables.reshape(-1), scripts.reshape(-1)])
        some = np.flatnonzero(flat)
        for a in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[a : a + (1 << 16)]), pa.array(flat[some[a : a + (1 << 16)]])], ["slot", "n"])

    return run


def train(docs: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample of the rows that are ``allowed`` and have a language."""
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    keyed = rows.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"))
    known = keyed.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()  # one row for each language
    languages = tuple(sorted(r.lang for r in known))
    if not languages:
        return Model((), np.zeros((len(ORDERS) + 1, 1 << TABLE_BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES) + 1, 0), bool))
    # of a common language, only about twice as many ids as are wanted reach the ranking
    shares = keyed.sparkSession.createDataFrame([(r.lang, min(1.0, 2.0 * per_language / r.n)) for r in known], "lang string, share double")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    few = keyed.join(F.broadcast(shares), "lang").where(place < F.col("share") * (1 << 31)).select("id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))
    ids = few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("id", "lang")
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    # at most per_language rows for each language
    sample = texts.join(F.broadcast(ids) if len(languages) <= 200 else ids, ["id", "lang"]).select("text", "lang")
    tally = sample.mapInArrow(_tally(languages), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    shape, extra = (len(ORDERS) + 1, 1 << TABLE_BITS, len(languages)), (len(SCRIPT_NAMES) + 1, len(languages))
    flat = np.zeros(int(np.prod(shape) + np.prod(extra)))
    flat[tally.column("slot").to_numpy()] = tally.column("n").to_numpy()
    tables, scripts = flat[: np.prod(shape)].reshape(shape), flat[np.prod(shape) :].reshape(extra)
    logs = np.log((tables + SMOOTHING) / (tables.sum(1, keepdims=True) + SMOOTHING * shape[1]))
    odds = (logs - logs.mean(2, keepdims=True)).astype(np.float32)
    used = scripts >= 0.01 * np.maximum(scripts[1:].sum(0), 1)
    return Model(languages, odds, used)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of each row; spans: first word, word after the last, language."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, lang_pred string, score double" + ", spans array<struct<first:int,until:int,lang:string>>" * spans
    return texts.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), spans), kinds)

"""Unigram token counts without the tokens: Aho-Corasick matches, and a Viterbi pass over scores and counts.

The vocabulary and its scores come from a SentencePiece model file, read as a unigram model. An automaton
enumerates the pieces that end at each character; the pass keeps for each position the best score and the
number of pieces of the path that has it. Ties follow the tokenizers library's unigram encoder: scores are
64-bit floats, a candidate replaces the best only if it is greater, and candidates come by ascending start,
so that the longest piece wins. A character that is no piece costs the lowest score less 10; with byte
fallback it counts as its UTF-8 bytes, else a run of such characters counts as one.

Null texts have no tokens. Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import bytewords as bw
from evispark.llm.piece_model import MARK, NORMAL, UNUSED, USER, Model, chunks_of, parse
from evispark.llm.pieces import SLICE, PieceCache

#: Fixed value of the tokenizer: what an unknown character costs beyond the lowest score.
UNKNOWN_PENALTY = 10.0


def counter(model: Model):
    """A function from a normalised text (with markers) to its number of unigram pieces."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score, kind in model.pieces:
        if kind in (NORMAL, USER, UNUSED) and piece:
            automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min(s if t in (NORMAL, USER, UNUSED) else -1e9 for _, s, t in model.pieces) - UNKNOWN_PENALTY

    def count(text: str) -> int:
        size = len(text)
        best, pieces = [None] * (size + 1), [0] * (size + 1)
        strange, single = bytearray(size + 1), bytearray(size + 1)
        best[0] = 0.0
        done = 0  # positions up to here have their best

        def settle(to: int) -> None:
            nonlocal done
            for at in range(done + 1, to + 1):
                if not single[at]:
                    score = best[at - 1] + unknown
                    if best[at] is None or score > best[at]:
                        more = len(text[at - 1].encode()) if model.byte_fallback else 1 - strange[at - 1]
                        best[at], pieces[at], strange[at] = score, pieces[at - 1] + more, 1
            done = to

        for last, (length, score) in automaton.iter(text):
            if done < last:
                settle(last)
            start, at = last + 1 - length, last + 1
            if length == 1:
                single[at] = 1
            score += best[start]
            if best[at] is None or score > best[at]:
                best[at], pieces[at] = score, pieces[start] + 1
        settle(size)
        return pieces[size]

    return count


@lru_cache(2)
def _cache(path: str) -> PieceCache:
    with open(path, "rb") as f:
        model = parse(f.read())
    if model.charsmap or model.squeeze or not model.dummy_prefix or not model.chunked:
        raise ValueError("only models that keep white space, mark the start and chunk at spaces can be cached by chunk")
    count = counter(model)
    return PieceCache(lambda chunks: [[[count(c.decode().replace(" ", MARK))] for c in chunks]])


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        for batch in batches:
            for a, b in bw.slices(batch.column(1), SLICE):
                data, start, end, row, _ = chunks_of(batch.column(1).slice(a, b - a))
                [(values, _)] = cache.look_up(data, start, end, bw.hash_spans(data, start, end))
                n = np.bincount(row, weights=values, minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n)], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_run(model), "doc_id long, n_tokens long")

"""Cross-tokenizer alignment: groups and links between the tokens that two tokenizers make of the same text.

A is a byte-level BPE (a tokenizers file), B a SentencePiece model; both read a space and the text. Token ends are added
up in bytes and merged by two pointers: where both end, a group ends; whenever one ends, its token and the other's current
one are a link. No token of either spans the start of a run of spaces after another character, so both cut there, groups
never cross it, and each distinct chunk between two such places is encoded and merged once for each cache (``pieces``).

``align`` writes its result to the shared folder, so that nothing is encoded twice: of each text the counts and its
distinct links. ``link_counts`` adds links up over the corpus; ``with_counts`` brings the counts back to the texts. A link
that makes one in HEAVY of all occurrences or more is joined by a broadcast (there can be no more than HEAVY of them, whatever
the corpus); only rare links are shuffled, so no key is hot.

Null and empty texts, and those whose tokens' bytes aren't a space and the text (SentencePiece reads its own marker as a
space), have no tokens: zeros, no groups. Special tokens in a text are plain text. Repeated rows give a row each.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import bytewords as bw
from evispark.llm.pieces import SLICE, PieceCache
from evispark.llm.tables import bound_batches, written

#: Most links that are broadcast; those with this share of all occurrences or more are.
HEAVY = 200_000
MARK = "▁"


def _bytes_of_a(tokenizer) -> list[bytes]:
    """Each id's bytes: byte-level vocabularies write a byte as a visible character, bytes without one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def _bytes_of_b(model) -> list[bytes]:
    """Each id's bytes: the marker is a space, <0xHH> a byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


def merge(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """(groups, links) of two sequences of ids that cover the same bytes."""
    groups, links, i, j, first_a, first_b = [], [], 0, 0, 0, 0
    end_a = size_a[a[0]] if a else 0
    end_b = size_b[b[0]] if b else 0
    while i < len(a):
        links.append((a[i], b[j]))
        ended = end_a - end_b
        if ended <= 0:
            i += 1
            end_a += size_a[a[i]] if i < len(a) else 0
        if ended >= 0:
            j += 1
            end_b += size_b[b[j]] if j < len(b) else 0
        if not ended:
            groups.append((a[first_a:i], b[first_b:j]))
            first_a, first_b = i, j
    return groups, links


@lru_cache(1)
def _aligner(byte_bpe: str, piece_model: str) -> PieceCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    own_a, own_b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=piece_model)
    own_a.encode_special_tokens = True
    bytes_a, bytes_b = _bytes_of_a(own_a), _bytes_of_b(own_b)
    size_a, size_b = list(map(len, bytes_a)), list(map(len, bytes_b))
    mark = [own_b.piece_to_id(MARK)]
    named: list[str] = list(map(str, range(max(len(bytes_a), len(bytes_b)))))

    def encode(chunks: list[bytes]):
        """Of each chunk (which starts with a space): its groups as text, its links, and its numbers of A, B, groups, and 1 if its bytes aren't kept."""
        texts = [c.decode() for c in chunks]
        of_a = [e.ids for e in own_a.encode_batch_fast(texts, add_special_tokens=False)]
        of_b = own_b.encode([t[1:] for t in texts], num_threads=1)
        shown, pairs, numbers = [], [], []
        for chunk, a, b in zip(chunks, of_a, of_b, strict=True):
            b = b or mark  # a lone space: an empty text has no ids, but this chunk has its marker
            if b"".join([bytes_a[x] for x in a]) != chunk or b"".join([bytes_b[x] for x in b]) != chunk:
                shown.append(b"")
                pairs.append(())
                numbers.append((0, 0, 0, 1))
                continue
            groups, links = merge(a, b, size_a, size_b)
            shown.append("".join([f"{','.join([named[x] for x in g])}|{','.join([named[x] for x in h])};" for g, h in groups]).encode())
            pairs.append([x << 32 | y for x, y in links])
            numbers.append((len(a), len(b), len(groups), 0))
        return shown, pairs, numbers

    return PieceCache(encode, (np.uint8, np.int64, np.int32))


def chunks_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of the chunks; every non-empty row gets a space in front.

    A chunk starts at a space after what can't be white space: an ASCII sign, or a letter of two bytes (but those from
    U+0080 to U+00BF, of which two are white space) or of three that start with 0xE4 to 0xEF, or of four.
    """
    data, offsets = bw.text_bytes(column)
    some = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][some], 32)
    offsets = offsets + np.append(0, np.cumsum(some))
    solid = (data > 32) & (data < 128)
    for back, low, high in ((1, 0xC3, 0xDF), (2, 0xE4, 0xEF), (3, 0xF0, 0xF7)):
        solid[back:] |= (data[back:] >= 128) & (data[:-back] >= low) & (data[:-back] <= high)
    first = np.zeros(len(data), bool)
    first[1:] = (data[1:] == 32) & solid[:-1]
    first[offsets[:-1][some]] = True
    start = np.flatnonzero(first)
    return data, start, np.append(start[1:], len(data)), bw.rows_of(start, offsets)


def _run(byte_bpe: str, piece_model: str, digest: bool):
    def rows(ids: pd.Series, column: pa.Array) -> pd.DataFrame:
        data, start, end, row = chunks_of(column)
        (text, n_text), (pairs, n_pairs), (numbers, _) = _aligner(byte_bpe, piece_model).look_up(data, start, end, bw.hash_spans(data, start, end))
        n = len(column)
        chunk_ends = np.searchsorted(row, np.arange(n + 1))
        cut = lambda sizes: np.append(0, np.cumsum(sizes))[chunk_ends].tolist()
        total = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(numbers.reshape(-1, 4), axis=0, dtype=np.int64)])
        n_a, n_b, n_groups, lost = (total[chunk_ends[1:]] - total[chunk_ends[:-1]]).T
        at_text, at_pair, kept = cut(n_text), cut(n_pairs), lost == 0
        shown, a, b, times = [], [], [], []
        for i in range(n):
            whole = kept[i] and at_pair[i + 1] > at_pair[i]
            groups = text[at_text[i] : at_text[i + 1] - 1].tobytes() if whole else b""
            shown.append(groups.decode() if not digest else hashlib.sha256(groups).hexdigest() if whole else "")
            distinct, count = np.unique(pairs[at_pair[i] : at_pair[i + 1]] if whole else pairs[:0], return_counts=True)
            a.append((distinct >> 32).astype(np.int32))
            b.append(distinct.astype(np.int32))
            times.append(count.astype(np.int32))
        made = {"doc_id": ids.reset_index(drop=True), "n_a": n_a * kept, "n_b": n_b * kept, "n_groups": n_groups * kept, "n_links": np.diff(at_pair) * kept}
        return pd.DataFrame(made | {"groups": shown, "link_a": a, "link_b": b, "link_n": times})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            column = pa.array(frame["text"], pa.large_string(), from_pandas=True)
            for x, y in bw.slices(column, SLICE):
                yield rows(frame["doc_id"].iloc[x:y], column.slice(x, y - x))

    return run


def align(docs: DataFrame, byte_bpe: str, piece_model: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, link_a, link_b, link_n) of each text, written to the shared folder.

    groups: 'a1,a2|b1;a3|b2,b3', ids of A and B in order (with ``digest`` the SHA-256 of that; '' without tokens).
    link_a, link_b, link_n: the text's distinct links and how often each occurs. row tells rows of one doc_id apart.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, link_a array<int>, link_b array<int>, link_n array<int>"
    made = texts.mapInPandas(_run(byte_bpe, piece_model, digest), schema)
    return written(made.withColumn("row", F.monotonically_increasing_id()), "alignments")


def _links(alignments: DataFrame) -> DataFrame:
    """(row, a, b, n) of each text's distinct links."""
    zipped = F.explode(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n")))
    return alignments.select("row", zipped.alias("l")).select("row", "l.a", "l.b", "l.n")


def link_counts(alignments: DataFrame) -> DataFrame:
    """(a, b, count, best) of each pair of ids: its links in the corpus, and whether no other pair of its b has more."""
    counts = written(_links(alignments).groupBy("a", "b").agg(F.sum("n").alias("count")), "link-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # no more rows than B has ids
    return counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(alignments: DataFrame, counts: DataFrame) -> DataFrame:
    """``alignments`` with n_best (links whose count is their b's highest) and count_sum (of the counts of all its links)."""
    counts = written(counts, "link-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    heavy = F.broadcast(counts.where(F.col("count") * HEAVY >= total))
    light = counts.where(F.col("count") * HEAVY < total)
    links = _links(alignments)
    rare = links.join(F.broadcast(heavy.select("a", "b")), ["a", "b"], "left_anti").join(light, ["a", "b"])
    found = links.join(heavy, ["a", "b"]).unionByName(rare)
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return alignments.join(sums, "row", "left").select(*alignments.columns, zero("n_best"), zero("count_sum"))

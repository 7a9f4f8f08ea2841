"""SentencePiece models on the tokenizers library: parsing the model file, encoding, decoding, parity.

``parse`` reads the protobuf of a .model file; ``backend`` rebuilds it for the tokenizers library (normaliser,
metaspace marker, unigram scores or BPE merges, byte fallback). Texts are encoded in chunks: a run of spaces
and the characters up to the next space. No piece holds the marker after another character (``parse`` checks
it), so nothing is ever joined across chunks, and each distinct chunk goes through the library once for each
cache. Every chunk that does is compared with the sentencepiece library's own ids and decoded again.

Null texts are encoded as empty ones: no ids, empty text. Repeated rows give a row each.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import bytewords as bw
from evispark.llm.pieces import SLICE, PieceCache

MARK = "▁"
#: Fixed values of the format: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    unk_id: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @property
    def chunked(self) -> bool:
        """Whether no piece holds the marker after another character."""
        return not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER, UNUSED))


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message: integers, or bytes of fixed or counted length."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse(data: bytes) -> Model:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(tuple(pieces), trainer.get(3, UNIGRAM), unk, bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def backend(model: Model):
    """The model as a Tokenizer; its ids are the model file's."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        # pieces that no text may match keep their ids at a score that never wins
        scores = [(p, s if t in (NORMAL, USER, UNUSED) else -1e9) for p, s, t in model.pieces]
        core = models.Unigram(scores, unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p: s for p, s, t in model.pieces if t in (NORMAL, USER, UNUSED)}
        merges = []
        for whole, score in usable.items():
            for k in range(1, len(whole)):
                if whole[:k] in usable and whole[k:] in usable:
                    merges.append((-score, vocab[whole], vocab[whole[:k]], vocab[whole[k:]], whole[:k], whole[k:]))
        merges.sort()
        core = models.BPE(vocab, [m[4:] for m in merges], unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if model.chunked:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


@lru_cache(2)
def _codec(path: str, threads: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read()
    model = parse(data)
    if model.charsmap or model.squeeze or not model.dummy_prefix or not model.chunked:
        raise ValueError("only models that keep white space, mark the start and chunk at spaces can be cached by chunk")
    tokenizer, own = backend(model), sentencepiece.SentencePieceProcessor(model_proto=data)

    def encode(chunks: list[bytes]):
        """Of each chunk (which starts with a space): its ids, its decoded bytes, and 1 if the sentencepiece library has the same ids."""
        texts = [c.decode()[1:] for c in chunks]
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if "" in texts:  # a lone space: an empty text has no ids, but this chunk has its marker
            mark = [own.piece_to_id(MARK)]
            ids = [i if t else mark for i, t in zip(ids, texts, strict=True)]
        theirs = own.encode(texts, num_threads=1)
        decoded = tokenizer.decode_batch(ids, skip_special_tokens=False)
        same = [b"\1" if i == j or not t else b"\0" for i, j, t in zip(ids, theirs, texts, strict=True)]
        return ids, [b" " + t.encode() for t in decoded], same

    return PieceCache(encode, (np.uint32, np.uint8, np.uint8))


def chunks_of(column: pa.Array):
    """(bytes, start, end, row) of the chunks; every non-empty row gets the space that marks its start."""
    data, offsets = bw.text_bytes(column)
    size = np.diff(offsets)
    some = size > 0
    data = np.insert(data, offsets[:-1][some], 32)
    offsets = offsets + np.append(0, np.cumsum(some))
    first = data == 32
    first[1:] &= data[:-1] != 32
    begin = offsets[:-1][some]
    first[begin] = True
    if (at := data.tobytes().find(MARK.encode())) >= 0:
        # a marker in the text itself could join with a space after it: such rows stay whole
        raw, hit = data.tobytes(), set()
        while at >= 0:
            hit.add(int(np.searchsorted(offsets, at, side="right")) - 1)
            at = raw.find(MARK.encode(), at + 3)
        for r in hit:
            first[offsets[r] + 1 : offsets[r + 1]] = False
    start = np.flatnonzero(first)
    return data, start, np.append(start[1:], len(data)), bw.rows_of(start, offsets), offsets


def _run(path: str, threads: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _codec(path, threads)
        for batch in batches:
            for a, b in bw.slices(batch.column(1), SLICE):
                column = batch.column(1).slice(a, b - a)
                data, start, end, row, offsets = chunks_of(column)
                (ids, n_ids), (text, n_bytes), (flag, _) = cache.look_up(data, start, end, bw.hash_spans(data, start, end))
                n, size = (np.bincount(row, weights=c, minlength=b - a).astype(np.int64) for c in (n_ids, n_bytes))
                parity = np.bincount(row, weights=flag == 0, minlength=b - a) == 0
                ids, ends, text_ends = ids.astype(np.int32), np.append(0, np.cumsum(n)), np.append(0, np.cumsum(size))
                begin = np.minimum(text_ends[:-1] + 1, text_ends[1:])  # without the space that marks the start
                decoded = [text[s:e].tobytes() for s, e in zip(begin.tolist(), text_ends[1:].tolist(), strict=True)]
                own = [data[s + 1 : e].tobytes() if e > s else b"" for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                same = pa.array([x == y for x, y in zip(decoded, own, strict=True)])
                arrays = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(parity), same]
                names = ["doc_id", "n_tokens", "parity", "round_trip"]
                if digest:
                    crcs = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    arrays, names = [*arrays, pa.array(crcs, pa.int64())], [*names, "ids_crc32"]
                else:
                    whole = pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())
                    arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), whole], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode_decode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, parity, round_trip) and the ids and their decoded text, or with ``digest`` the CRC-32 of the ids.

    parity: the ids of every chunk equal the sentencepiece library's; round_trip: decoding gives the text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rest = "ids_crc32 long" if digest else "ids array<int>, decoded string"
    return texts.mapInArrow(_run(model, threads, digest), f"doc_id long, n_tokens long, parity boolean, round_trip boolean, {rest}")

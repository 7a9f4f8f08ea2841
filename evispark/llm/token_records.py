r"""Token ids as length-delimited binary records, with a separate offset index.

A record file holds, for each document in ascending doc_id order (null ids first, equal ids by text),

    length u64 | masked checksum of those 8 bytes u32 | payload | masked checksum of the payload u32 | 0x0A
    payload: 1 if the id is known else 0 (u8) | bytes of each token id, 2 or 4 (u8) | doc_id i64 | token ids

all little-endian. A checksum is the CRC-32 rotated right by 15 bits plus 0xA282EAD8, so that stored data
which itself holds checksums doesn't weaken it. The frames are written by Spark's own file writer and
committed task by task: a lost executor's task starts anew and leaves no half file, and any store that Spark
reaches will do. The index (Parquet: file, doc_id, offset, length, n_tokens, ids_crc32, first) lets a reader
fetch records in any order (``fetch``). Repeated rows give one record each; null texts have the end id only.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.llm import bytewords as bw
from evispark.llm.pieces import SLICE, PieceCache

#: Bytes of text that go into one file.
FILE_BYTES = 32 << 20
_COMMA, _DOT = 44, 46
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<BBq", doc_id is not None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


def unframe(data, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids, where the next record starts); raises ValueError on a broken record."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"broken length at byte {at}")
    size = struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) < size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"broken payload at byte {at}")
    known, width, doc_id = struct.unpack_from("<BBq", payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=10), at + 17 + size


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encode = lambda chunks: [[e.ids for e in tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]]
    return PieceCache(encode), 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4


def _trailing_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Cuts a final comma or full stop off each chunk that has an ASCII letter before it: no token spans the two."""
    last = data[end - 1]
    cut = ((last == _COMMA) | (last == _DOT)) & (end - start > 1) & _LETTER[data[np.maximum(end - 2, 0)]]
    parts = 1 + cut
    s, e = np.repeat(start, parts), np.repeat(end, parts)
    at = (np.cumsum(parts) - 1)[cut]
    s[at], e[at - 1] = end[cut] - 1, end[cut] - 1
    return s, e


def encode_column(column: pa.Array, path: str, end_id: int | None):
    """The token ids of each row, as a list of arrays.

    The tokenizer drops white space and joins nothing across it, so each chunk between spaces is looked up
    by itself. Chunks are lower-cased first, as the tokenizer does, unless a special token could be meant.
    """
    cache, _ = _tokenizer(path)
    data, offsets = bw.text_bytes(column)
    if b"<|" not in data.tobytes():
        data = bw.LOWER[data]
    start, end = _trailing_marks(data, *bw.spans(data, offsets)[:2])
    [(ids, counts)] = cache.look_up(data, start, end, bw.hash_spans(data, start, end))
    chunk_ends = np.append(0, np.cumsum(counts))
    ends = chunk_ends[np.searchsorted(start, offsets)]
    tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
    return [np.append(ids[a:b], tail) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _tokenizer(path)[1]
        for batch in batches:
            for a, b in bw.slices(batch.column(1), SLICE):
                ids = encode_column(batch.column(1).slice(a, b - a), path, end_id)
                keys = batch.column(0).slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([frame(k, x, width)[:-1] for k, x in zip(keys, ids, strict=True)], pa.binary())], ["record"])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            data, at, first, rows = memoryview(content.as_buffer()), 0, 0, []
            while at < len(data):
                doc_id, ids, to = unframe(data, at)
                rows.append((file.as_py(), doc_id, at, to - at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), first))
                first += len(ids)
                at = to
            names = ["file", "doc_id", "offset", "length", "n_tokens", "ids_crc32", "first"]
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def write_records(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Writes the record files of ``docs`` to ``path``/records and their index to ``path``/index."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = 1 + total // file_bytes
    dealt = texts.repartitionByRange(files, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(_frames(tokenizer, end_id), "record binary").select(F.col("record").cast("string")).write.text(f"{path}/records", lineSep="\n")
    read = docs.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    read.select("path", "content").mapInArrow(_index, "file string, doc_id long, offset long, length long, n_tokens long, ids_crc32 long, first long").write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of ``path`` with ``start``: the number of token ids in all records before."""
    index = spark.read.parquet(f"{path}/index").withColumn("file_no", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    files = index.groupBy("file_no").agg(F.sum("n_tokens").alias("tokens"))
    before = files.select("file_no", (F.sum("tokens").over(Window.orderBy("file_no")) - F.col("tokens")).alias("before"))
    return index.join(before, "file_no").withColumn("start", F.col("before") + F.col("first")).drop("before", "first")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, record) of the rows of the index in ``wanted``, cut out of the files by offset and length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select(F.col("path").alias("file"), "content")
    return wanted.join(files, "file").select("doc_id", F.expr("substring(content, int(offset + 1), int(length))").alias("record"))

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from evispark.llm import piece_model, token_counts, token_records
from evispark.llm.queries import vocabulary

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "\n", "  two  spaces ", "Hello, world. It's 12,5 o'clock...", "naïve ÉCOLE Straße", "tab\tand\nnewline\r\n", "日本語 テキスト", "emoji 😀😀 x", "<|endoftext|> <|ENDOFTEXT|> a",
    "a▁b ▁ c▁ d", "trailing ", "nbsp here", "comma,comma ,x, (y), 'tis", "<s> </s> <unk> <0x41>", "x" * 3000, "é combining", "word. word, WORD",
]


def more(seed, n=60):
    rng = random.Random(seed)
    alphabet = "abcdeéñ ABC  .,'\n12-😀"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]


def test_ids_equal_the_librarys_own():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary(WORD_BPE))
    texts = TEXTS + more(1)
    got = token_records.encode_column(pa.array(texts, pa.string()), vocabulary(WORD_BPE), 2)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*own.encode(text or "", add_special_tokens=False).ids, 2], text


def test_frames_round_trip_and_detect_damage():
    ids = np.array([1, 2, 49_000], np.uint32)
    data = token_records.frame(7, ids, 2) + token_records.frame(None, ids[:0], 2)
    doc_id, back, at = token_records.unframe(data)
    assert (doc_id, back.tolist()) == (7, ids.tolist()) and token_records.unframe(data, at)[0] is None
    for k in range(at - 1):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(broken))


def test_records_in_order_and_by_index(spark, tmp_path):
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(TEXTS + more(2))] + [(None, "no id", "x"), (0, "again", "x"), (0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = str(tmp_path / "records")
    token_records.write_records(docs, path, vocabulary(WORD_BPE), file_bytes=500)
    index = token_records.read_index(spark, path)
    got = index.orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [x.tolist() for x in token_records.encode_column(pa.array([r[1] for r in want], pa.string()), vocabulary(WORD_BPE), 2)]
    assert [r.doc_id for r in got] == [r[0] for r in want]
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert len({r.file for r in got}) > 1
    for r in token_records.fetch(spark, path, index.where("doc_id = 3")).collect():
        doc_id, back, _ = token_records.unframe(bytes(r.record))
        assert doc_id == 3 and back.tolist() in ids


def test_records_of_no_documents(spark, tmp_path):
    token_records.write_records(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "r"), vocabulary(WORD_BPE))
    assert token_records.read_index(spark, str(tmp_path / "r")).collect() == []


def test_piece_ids_and_texts_equal_the_librarys_own(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    texts = TEXTS + more(3)
    got = piece_model.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary(PIECES)).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        assert list(r.ids) == own.encode(text), text
        # a marker in the text itself decodes to a space, as in the library
        assert r.decoded == own.decode(list(r.ids)) and r.round_trip == (r.decoded == text) == ("▁" not in text)
        assert r.parity and r.n_tokens == len(r.ids)
    assert len(got) == len(texts)


def unigram_model():
    """The public vocabulary file read as a unigram model: its kind, a field of the trainer's part, is set to 1."""
    with open(vocabulary(PIECES), "rb") as f:
        data = f.read()
    model = piece_model.parse(data)
    assert model.kind == piece_model.BPE
    return piece_model.Model(model.pieces, piece_model.UNIGRAM, model.unk_id, model.byte_fallback, model.charsmap, model.dummy_prefix, model.squeeze)


def test_counts_equal_the_librarys_unigram_encoder(spark):
    tokenizer = piece_model.backend(unigram_model())
    texts = [t for t in TEXTS + more(4) if not t or "<" not in t]  # the library also matches control pieces in texts
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary(PIECES)).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.n_tokens == (len(tokenizer.encode(text, add_special_tokens=False).ids) if text else 0), text
    assert len(got) == len(texts)


def test_count_ties_keep_the_longest_piece():
    pieces = tuple((p, s, piece_model.NORMAL) for p, s in (("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -5.0)))
    count = token_counts.counter(piece_model.Model(pieces, piece_model.UNIGRAM, 0, False, b"", True, False))
    assert count("ab") == 1 and count("abab") == 2 and count("zz") == 1 and count("azzb") == 3 and count("") == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, vocabulary(PIECES)).collect() == []
    assert piece_model.encode_decode(none, vocabulary(PIECES)).collect() == []

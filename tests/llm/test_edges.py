"""Very long texts, repeated rows and clashing columns where the other tests have none; and every thin query on the small tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from evispark.llm import near_dup, piece_model, queries, token_counts, token_records, toxicity

SF = "/root/testdata/sf0.001"
WORD_BPE, PIECES = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("piece_bpe_32k.model")


def long_text(seed, n=150_000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_records_of_a_very_long_text(spark, tmp_path):
    text = long_text(1)
    docs = spark.createDataFrame([(1, "a b", 5), (2, text, 5), (3, None, 5)], "doc_id long, text string, n_tokens int")
    token_records.write_records(docs, str(tmp_path / "r"), WORD_BPE)
    got = {r.doc_id: r for r in token_records.read_index(spark, str(tmp_path / "r")).collect()}
    [ids] = token_records.encode_column(pa.array([text]), WORD_BPE, 2)
    assert got[2].n_tokens == len(ids) > 150_000 and got[2].ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and got[3].start == got[2].start + len(ids)


def test_near_duplicates_of_a_very_long_text(spark):
    text = long_text(2)
    rows = [(5, text), (9, text + " end"), (7, text[: len(text) // 2]), (8, "short one here"), (6, text)]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == {5: (5, True), 6: (5, False), 9: (5, False), 7: (7, True), 8: (8, True)}


def test_pieces_with_clashing_columns_and_a_very_long_text(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = long_text(3)
    docs = spark.createDataFrame([(1, text, 0, "x", True), (1, "twice", 0, "x", True), (1, "twice", 0, "x", True)], "doc_id long, text string, n_tokens int, ids string, parity boolean")
    got = sorted((r.n_tokens, r.parity, r.round_trip) for r in piece_model.encode_decode(docs, PIECES).collect())
    assert got == sorted((len(own.encode(t)), True, True) for t in (text, "twice", "twice"))
    counts = sorted(r.n_tokens for r in token_counts.token_counts(docs, PIECES).collect())
    assert len(counts) == 3 and counts[0] == counts[1] and counts[2] > 100_000


def test_toxicity_of_repeated_rows_and_a_very_long_text(spark):
    rows = [(i, f"vile rot number{i}") for i in range(0, 60, 2)] + [(i, f"good day number{i}") for i in range(1, 60, 2)] + [(2, "vile rot number2")] * 3
    rows += [(100, long_text(4)), (101, "vile rot " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(50)], "doc_id long, toxic int")
    got = toxicity.grade(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 2 and r.toxic for r in got) == 4
    assert {r.doc_id: r.toxic for r in got if r.doc_id >= 100} == {100: False, 101: True}


def test_toxicity_is_fitted_on_one_row_of_an_id(spark, monkeypatch):
    """A thousand rows of one labelled id, and texts beyond the bound, change nothing of the model."""
    rows = [(i, f"vile rot number{i}") for i in range(0, 60, 2)] + [(i, f"good day number{i}") for i in range(1, 60, 2)]
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(50)] + [(100, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FIT_BYTES", 1000)
    plain = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    more = rows + [rows[0]] * 1000 + [(100, "good day " * 200)]
    model = toxicity.train(spark.createDataFrame(more, "doc_id long, text string"), labels)
    assert np.allclose(plain.weights, model.weights, atol=1e-6) and np.allclose(plain.thresholds, model.thresholds, atol=1e-6)


#: The columns of the results, and whether there is a row for each row of the table.
THIN = {
    "op1_token_records": ("doc_id start n_tokens ids_crc32", "documents"), "op2_html_text": ("page_id url text n_chars", "pages"), "op3_decontaminate": ("doc_id item_id similarity", None),
    "op4_neighbours": ("query_id rank vec_id score", None), "op5_near_duplicates": ("doc_id n_shingles component_id kept", "documents"), "op6_line_dedup": ("doc_id", None), "op7_token_counts": ("doc_id n_tokens", "documents"),
    "op8_toxicity": ("doc_id expected_severity grade toxic", "documents"), "op9_sentencepiece": ("doc_id n_tokens parity round_trip ids_crc32", "documents"), "op10_language": ("doc_id held_out lang_pred score", "documents"),
    "op11_secrets": ("doc_id n_assign n_access n_hex base_sha256 spans", "documents"), "op12_alignment": ("doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "documents"),
}


@pytest.mark.parametrize("name", sorted(THIN))
def test_thin_queries(spark, name):
    columns, table = THIN[name]
    found = queries.QUERIES[name](spark, SF)
    assert set(columns.split()) <= set(found.columns)
    n = found.count()
    assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() if table else n > 0


def test_token_totals_of_the_thin_queries(spark):
    """op1's starts follow on one another, op9's parity holds everywhere, op12 counts the library's ids."""
    import sentencepiece

    rows = sorted(queries.op1_token_records(spark, SF).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist() and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.n_b == len(own.encode(texts[r.doc_id])) for r in queries.op12_alignment(spark, SF).collect() if "▁" not in texts[r.doc_id])
    assert all(r.parity and r.round_trip for r in queries.op9_sentencepiece(spark, SF).collect())

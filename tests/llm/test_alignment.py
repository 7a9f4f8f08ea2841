"""Alignment against the libraries' own encoders on whole texts, with every pair of tokens compared."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import pytest

from evispark.llm import alignment, queries
from evispark.llm.queries import vocabulary

TEXTS = [
    None, "", " ", "\n", "  two  spaces ", "Hello, world. It's 12,5 o'clock...", "naïve ÉCOLE Straße  é  é", "tab\tand\nnewline\r\n", "a\n  b\n\n   c \n d", "日本語 テキスト　全角 x", "emoji 😀😀 x 😀 y",
    "<|endoftext|> <|ENDOFTEXT|> a", "a▁b ▁ c▁ d", "trailing ", "trailing   ", "nbsp here and  em    x", "<s> </s> <unk> <0x41>", "x" * 3000, "combiné é ", "word. word, WORD", "\x00 \x1c \x85 y \x85 z",
    "don't we'll  they've", "  a", "   ", "Ω мир  мир", "​ ​",
]


def more(seed, n=60):
    rng = random.Random(seed)
    alphabet = "abcdeéñ ABC  .,'\n12-😀 　日\t"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def own():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    return a, b


@lru_cache(1)
def byte_of():
    """The byte of each character of a byte-level entry: the library's own table read the other way round."""
    from tokenizers import pre_tokenizers

    table = {}
    # characters in which every byte of UTF-8 stands
    for code in (*range(0xC0), *range(0xC0, 0x800, 0x40), *range(0x800, 0xD800, 0x400), 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000):
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
        table |= dict(zip(shown, chr(code).encode(), strict=True))
    return table


def plain_row(own, text):
    """(ids of a, ids of b, groups, links) from whole encodings; None where a text has no tokens."""
    a, b = own
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of()[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    ranges = []
    for parts in (bytes_a, bytes_b):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        ranges.append(out)
    ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    groups, low = [], 0
    for end in ends:
        inside = [[str(i) for i, (s, e) in zip(ids, of, strict=True) if low <= s and e <= end] for ids, of in zip((ids_a, ids_b), ranges, strict=True)]
        groups.append("|".join(",".join(x) for x in inside))
        low = end
    links = [(i, j) for i, (s, e) in zip(ids_a, ranges[0], strict=True) for j, (t, f) in zip(ids_b, ranges[1], strict=True) if s < f and t < e]
    return ids_a, ids_b, groups, links


def test_rows_equal_whole_encodings(spark, tmp_path, own, monkeypatch):
    monkeypatch.setattr(alignment, "HEAVY", 40)  # so that both ways of joining are taken
    texts = TEXTS + more(1) + more(2)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "x"), (5, TEXTS[5], 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, row int, groups string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_alignment(spark, str(tmp_path)).collect()
    made = [plain_row(own, r[1] or "") for r in rows]
    counts = Counter(link for m in made if m for link in m[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for (doc_id, *_), m in zip(rows, made, strict=True):
        if m is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        best, total = sum(counts[x] == most[x[1]] for x in m[3]), sum(counts[x] for x in m[3])
        want.append((doc_id, len(m[0]), len(m[1]), len(m[2]), len(m[3]), best, total, hashlib.sha256(";".join(m[2]).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_groups_and_links_are_kept(spark, own):
    text = "It's naïve 😀"
    [r] = alignment.align(spark.createDataFrame([(7, text)], "doc_id long, text string"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()
    _, _, groups, links = plain_row(own, text)
    assert r.groups == ";".join(groups) and Counter({(a, b): n for a, b, n in zip(r.link_a, r.link_b, r.link_n, strict=True)}) == Counter(links)


def test_merge_by_hand():
    size = [1, 2, 3, 4]
    assert alignment.merge([1, 0, 2], [2, 0, 1], size, size) == ([([1, 0], [2]), ([2], [0, 1])], [(1, 2), (0, 2), (2, 0), (2, 1)])
    assert alignment.merge([], [], size, size) == ([], [])


def test_long_texts_and_empty_tables(spark, own):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    names = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    [r] = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *names).collect()
    assert (r.n_a, r.n_b) == (len(own[0].encode(" " + text, add_special_tokens=False).ids), len(own[1].encode(text)))
    assert r.n_links == sum(r.link_n) and r.n_groups == r.groups.count("|")
    none = alignment.align(spark.createDataFrame([], "doc_id long, text string"), *names)
    assert alignment.with_counts(none, alignment.link_counts(none)).collect() == []

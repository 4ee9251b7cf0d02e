"""Piece encoding and token counts against the libraries of the vocabulary files."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import queries, sentence_pieces, token_counts

SF_DIR = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
CASES = [
    None, "", " ", "  a  b ", "\n\ta", "▁x", "é ü ﬁ①", "日本́語", "<s>x</s>", "a​b\xa0c",
    "aaaaaaaaaaaaaaaaaaaaaaaaa", "   " * 13, "  \n   \n\n x", "----------====", "\x00a", "😀😀 xx",
    "x" * 3000, "ab" * 1000, "لا إله", "<|endoftext|>hi !<|endoftext|><|endoft",
    "don't we'll I'RE 're 'l", "http://www.example.com/aaa/bbb?x=1&y=2",
]


def noise(n, longest):
    rng = random.Random(5)
    for _ in range(n):
        yield "".join(rng.choice("ab 's<|\n\tréeln 1.-▁") for _ in range(rng.randint(0, longest)))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


def test_pieces_of_cases_and_noise(library):
    codec = sentence_pieces.codec(PIECES)
    for text in [t or "" for t in CASES] + list(noise(3000, 30)):
        ids = codec.encode(text)
        assert ids == library.encode(text), text
        assert codec.decode(ids) == library.decode(ids) == text.replace("▁", " ")


def test_stream_gives_pieces_before_the_end(library):
    codec = sentence_pieces.codec(PIECES)
    read = 0

    def endless():
        nonlocal read
        for char in "▁the" + "▁quick▁brown▁fox" * 1000:
            read += 1
            yield char

    stream = sentence_pieces.streamed(endless(), codec.merges)
    assert next(stream) == "▁the"
    assert read <= 4 * codec.merges.longest
    assert "".join(stream) == "▁quick▁brown▁fox" * 1000


def test_every_joined_piece_is_known():
    merges = sentence_pieces.codec(PIECES).merges
    assert set(merges.pieces) == set(merges.born)


def test_counts_of_cases_and_noise(byte_library):
    counter = token_counts.counter(BYTES, public_tokenizers.PATTERN)
    for text in [t or "" for t in CASES] + list(noise(2000, 30)):
        assert counter.count(text) == len(byte_library.encode(text, add_special_tokens=False).ids), text


def test_counts_of_all_prefixes(byte_library):
    counter = token_counts.counter(BYTES, public_tokenizers.PATTERN)
    for text in [(t or "")[:120] for t in CASES] + list(noise(800, 14)):
        expected = [len(byte_library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.counts(text) == expected, text
        budget = counter.prefix_within(text, 3)
        assert max(expected[: budget + 1]) <= 3 and (budget == len(text) or expected[budget + 1] > 3)


def test_queries_match_libraries(spark, library, byte_library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for row in queries.op4_token_counts(spark, SF_DIR).collect():
        tokens = len(byte_library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), tokens, tokens > 512)
    rows = queries.op3_sentence_pieces(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.ids == library.encode(texts[row.doc_id]) and row.n_ids == len(row.ids) and row.round_trip


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id int, text string, ids int")
    coded = sentence_pieces.encode(docs, PIECES)
    assert sorted((r.id or 0, len(r.ids), r.round_trip) for r in coded.collect()) == [(0, 2, True), (1, 0, True), (1, 0, True)]
    assert sorted(r.text for r in sentence_pieces.decode(coded, PIECES).collect()) == ["", "", "a b"]
    counted = token_counts.count_tokens(docs, BYTES, public_tokenizers.PATTERN)
    assert sorted((r.id or 0, r.n_bytes, r.n_tokens) for r in counted.collect()) == [(0, 3, 2), (1, 0, 0), (1, 0, 0)]
    prefixes = token_counts.count_prefixes(docs, BYTES, public_tokenizers.PATTERN)
    assert sorted(r.counts for r in prefixes.collect()) == [[0], [0], [0, 1, 2, 2]]
    assert sentence_pieces.encode(docs.limit(0), PIECES).count() == 0

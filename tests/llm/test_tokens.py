"""Encoding and decoding, streamed."""

import random

import pytest

from tracewell.llm import tokens as T

path = T.vocabulary_file()


@pytest.fixture(scope="module")
def transducer():
    return T.Transducer(T.vocabulary(path), T.lookahead_of(path), block=500)


def samples():
    rng = random.Random(5)
    yield from ("", "a", " ", "\n\n\n", "<|endoftext|>", "don't  we'll\t'RE", "naïve é日本語 👍🏽", "\x00\x1f�", "a" * 9000, " " * 9000, "\n \n" * 3000, "1" * 9000, "日" * 4000, "=-" * 4000, "a!\x1c" * 900, "! " * 3000, "日本、" * 900, "x\x85y\u2003z" * 500, " \n\n  a" * 800)
    for _ in range(60):
        parts = rng.choice([["the", "ing", "an", "ti"], [" ", "\n", "\t", "a"], ["é", "日", "м", "👍"], list("etaoinshr"), ["'s", "'re", "'", " '"]])
        yield "".join(rng.choice(parts) for _ in range(rng.randrange(400, 3000)))


def test_same_ids_as_the_whole_text_at_once(transducer):
    for text in samples():
        assert transducer.encode(text) == transducer.encoding.encode_ordinary(text), repr(text[:40])


def test_same_ids_as_the_other_library(transducer):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in samples():
        assert transducer.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded(transducer):
    sizes = [len(ids) for ids in transducer.stream("x" * 200_000)]
    assert len(sizes) > 300 and max(sizes) <= transducer.block


def test_round_trip(transducer):
    decoder = T.Decoder(T.vocabulary(path))
    for text in samples():
        assert decoder.decode(transducer.encode(text)) == text
    assert list(decoder.stream(transducer.encode("日"))) == ["日"] and decoder.decode([]) == decoder.decode(None) == ""


def test_lookahead_rules():
    assert T.lookahead({1: (b"a", b"b")}) == 1
    assert T.lookahead({1: (b"b", b"c"), 2: (b"a", b"b")}) == 2  # whether a takes b depends on the c behind it
    assert T.lookahead({1: (b"a", b"b"), 2: (b"b", b"c")}) == 1


def test_tables(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (1, "Hello world", "x"), (2, "", None), (3, None, None), (None, "a" * 300_000, "")], "doc_id long, text string, ids string")
    got = T.encoded(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got)[1:] == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert [r.n_tokens for r in T.counted(df.where("doc_id = 1"), "doc_id", "text").collect()] == [2, 2]
    back = T.decoded(T.encoded(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert sorted(len(r.text) for r in back) == [0, 0, 11, 11, 300_000]
    assert T.encoded(df.limit(0), "doc_id", "text").count() == 0

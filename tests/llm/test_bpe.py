"""The automaton against the tokenizers library, and round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.bpe import BpeCodec, codec, decode_documents, encode_documents, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, text):
    ids = codec(PATH).encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want, text
    assert codec(PATH).decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_corpus(library, spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        same(library, r["text"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(library, text):
    same(library, text)


def test_mixed_fragments(library):
    draw = random.Random(3)
    parts = ["a", "aa", "aaaa", "the", "ing", " ", "  ", "\n", "é", "日本", "<|endoftext|>", "0", "12", "'s", "'ll", "\x1c", "\u3000", "𝔸", "\xad", "ﬁ", "ب", "ŉ", "²"]
    for _ in range(2000):
        same(library, "".join(draw.choices(parts, k=draw.randint(0, 12))))


def test_long_word_and_empty(library):
    same(library, "")
    same(library, "ab" * 30000)
    assert codec(PATH).encode(None) == []


def test_states_only_forbid_what_would_merge():
    c = BpeCodec(PATH)
    a = c.automaton
    t, h = a.ids[b"t"], a.ids[b"h"]
    assert not a.has(t, h)  # "th" is a merge, so h can't follow t
    assert a.encode(b"th") == [a.ids[b"th"]]


def test_table_is_what_the_gadgets_make():
    from millrace.llm.bpe import TokenAutomaton

    a = codec(PATH).automaton
    draw, tokens = random.Random(4), list(a.label)
    pairs = [(draw.choice(tokens), draw.choice(tokens)) for _ in range(50_000)] + [(a.ids[x], a.ids[y]) for x in (b"t", b" t", b"in") for y in (b"h", b"g", b"he", b"ing")]
    assert all(a.has(u, v) == a._has(u, v, len(a.made)) for u, v in pairs)
    assert len(a.table.lacks) < 20_000_000
    small = TokenAutomaton({"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [("a", "b"), ("b", "a"), ("ab", "a")])
    assert [small.encode(w) for w in (b"aba", b"bab", b"baba", b"abab")] == [[4], [1, 2], [1, 4], [2, 2]]
    again = TokenAutomaton({"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [], small.table)
    assert again.encode(b"bbaba") == small.encode(b"bbaba")


def test_frames(spark):
    docs = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7), (3, "", 7)], "doc_id long, text string, ids int")
    out = encode_documents(docs, PATH)
    assert sorted((r["doc_id"], len(r["ids"])) for r in out.collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert {r["doc_id"]: r["text"] for r in decode_documents(out, PATH).collect()} == {1: "hello world", 2: "", 3: ""}
    assert encode_documents(docs.where("false"), PATH).count() == 0

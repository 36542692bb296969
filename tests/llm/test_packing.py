"""Packing: what is packed, that it fits, and that local search helps."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing as P
from millrace.llm.bpe import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_against_library(library):
    e, draw = P.Encoder(PATH), random.Random(5)
    parts = ["a", "The", "ING", " ", "\n", "é", "É", "日", "<|endoftext|>", "12", "'s", "'", "''", "²", "ß", "\xa0", "İ", "ŉ", "€", "—", "\x1c", "Σ", "ς", "é", "ﬁ", "Ǆ", "ẞ"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 10))) for _ in range(3000)] + [None, "", "x" * 10_000]
    for text, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def valid(bins, lengths, capacity):
    return sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= capacity for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_packs_are_valid_and_never_worse(lengths):
    first = P.best_fit(lengths, 100)
    assert valid(first, lengths, 100)
    better = P.local_search([list(b) for b in first], lengths, 100)
    assert valid(better, lengths, 100) and len(better) <= len(first)


def test_local_search_empties_bins():
    lengths = [6, 5, 5, 4, 3, 3, 2, 2]  # 30 = 3 x 10
    assert len(P.local_search([[0, 4], [1, 5], [2, 6], [3, 7]], lengths, 10)) == 3
    draw = random.Random(2)
    lengths = [draw.randint(900, 2100) for _ in range(400)]
    first = P.best_fit(lengths, 4096)
    before = len(first)
    assert len(P.local_search(first, lengths, 4096)) < before


def test_local_search_has_no_cap():
    draw = random.Random(1)
    lengths = [draw.randint(900, 2100) for _ in range(4096)]
    first = P.best_fit(lengths, 4096)
    found = P.local_search([list(b) for b in first], lengths, 4096)
    assert valid(found, lengths, 4096) and len(first) - len(found) >= 39  # 4 of them within 500 steps


def test_local_search_ends_where_no_exchange_helps():
    draw = random.Random(3)
    lengths = [draw.randint(900, 2100) for _ in range(120)]
    found = P.local_search(P.best_fit(lengths, 4096), lengths, 4096)
    assert len(found) > -(-sum(lengths) // 4096)
    sums = [sum(lengths[i] for i in b) for b in found]
    for a, b in itertools.permutations(range(len(found)), 2):
        for gone, come in ((1, 0), (1, 1), (1, 2), (2, 1)):
            for x in itertools.combinations(found[a], gone):
                for y in itertools.combinations(found[b], come):
                    d = sum(lengths[i] for i in x) - sum(lengths[i] for i in y)
                    assert not (0 < d <= 4096 - sums[b] and sums[b] + d > sums[a])


def rows_are_right(rows, docs, library, capacity):
    sequences, of = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        of[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(of[doc_id], key=lambda r: r["piece"])
        assert [r["start"] for r in got] == list(range(0, len(ids), capacity))
        for r in got:
            part = ids[r["start"] : r["start"] + capacity]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    return len(sequences)


def test_query(spark, sf, library):
    rows = P.op1_packing(spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = rows_are_right(rows, docs, library, 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) * 1.02 + 1


def test_edges(spark, library):
    docs = [(1, None), (2, ""), (3, "word " * 9000), (4, "a b"), (None, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS block", "text AS piece")
    rows = P.pack_documents(frame, PATH, in_block=2).collect()
    rows_are_right(rows, docs, library, 4096)
    assert P.pack_documents(frame.where("false"), PATH).count() == 0
    twice = P.pack_documents(frame.union(frame).where("doc_id = 4"), PATH).collect()
    assert len(twice) == 2 and {r["offset"] for r in twice} == {0, 3}


def test_no_value_makes_a_block_large(spark):
    frame = spark.createDataFrame([(None, "a b c"), (7, "a b c")] * 300, "doc_id long, text string")
    rows = P.pack_documents(frame, PATH, capacity=40, in_block=50).collect()
    assert len(rows) == 600 and len({r["sequence_id"] >> 32 for r in rows}) == 12
    long = P.pack_documents(spark.createDataFrame([(1, "word " * 40_000)], "doc_id long, text string"), PATH, capacity=40, in_block=50).collect()
    assert len(long) == 1001 and len({r["sequence_id"] >> 32 for r in long}) > 15  # blocks are counted by pieces

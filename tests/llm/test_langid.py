"""The forward pass against enumeration, and accuracy on rows that were not learned from."""

import itertools
import zlib

import numpy as np
import pytest

from millrace.llm import langid as L


@pytest.fixture(scope="module")
def model():
    return L.LanguageModel(["x", "y"], [0.0, 0.0], np.random.default_rng(1).random((len(L.vocabulary()) + 1, 2)) / 1000)


@pytest.mark.parametrize("word", ["the", "été", "zqß", "houses", "日本", "a"])
def test_all_segmentations(model, word):
    part, total = f"▁{word}", np.zeros(2)
    n = len(part)
    for k in range(n):
        for c in itertools.combinations(range(1, n), k):
            ends, p = [0, *c, n], np.ones(2)
            for a, b in itertools.pairwise(ends):
                at = L.vocabulary().get(part[a:b], -1 if b - a == 1 else None)
                p = p * (0 if at is None else model.probability[at])
            total += p
    assert np.allclose(np.log(total), model.word_logs([word])[0])


def test_long_words_are_summed_in_parts(model):
    word = "abc" * 100
    assert np.allclose(model.word_logs([word])[0], model.part_logs(L.parts(word)).sum(axis=0)) and "".join(L.parts(word)) == f"▁{word}"


def test_unseen_script_does_not_underflow():
    rare = np.full((len(L.vocabulary()) + 1, 2), [1e-9, 1e-7])  # y has less training data, so what is unseen costs it less
    for p in ("▁the", "▁house", "▁of", "▁man"):
        rare[L.vocabulary()[p]] = [0.05, 1e-7]
    run = "".join(chr(0x1200 + i) for i in range(100))
    model = L.LanguageModel(["x", "y"], [0.0, 0.0], rare)
    each = model.word_logs([run])[0]
    assert np.isfinite(each).all() and np.allclose(each, (len(run) + 1) * np.log([1e-9, 1e-7]), rtol=0.05)
    got = L.Scorer(model).predict([run, f"{run} " + "the house of the man " * 40])
    assert got[0][0] == "y" and got[1][:2] == ("x", pytest.approx(1.0))


def test_undetermined(model):
    s = L.Scorer(model)
    got = s.predict([None, "", "123 !?", "²", "ok"])
    assert [g[0] for g in got[:4]] == ["und"] * 4 and got[4][0] in ("x", "y") and all(0 <= g[1] <= 1 for g in got)
    empty = L.LanguageModel([], [], np.zeros((len(L.vocabulary()) + 1, 0)))
    assert L.Scorer(empty).predict(["hello"]) == [("und", 0.0, 0.0, 0)]


def test_cache_does_not_change_results(model, monkeypatch):
    texts = ["one two three", "two four", "five one"]
    want = L.Scorer(model).predict(texts)
    monkeypatch.setattr(L, "KEPT_WORDS", 0)
    s = L.Scorer(model)
    got = [s.predict([t])[0] for t in texts]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op7_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) >= 0.98


def test_typical_texts(spark):
    """Foreign texts of other scripts and random letters are below the floor, short and long texts of the learned languages are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    fits = L.typical(docs, model)
    foreign = ["日本語の文章はここにあります。とても長いです。" * 5, "Это предложение написано на другом языке, и оно довольно длинное. " * 5, "xqzj wvkq zxxq jjqw vvkz qqxj " * 20]
    fine = ["the", "is that", "la", "und der", "The house of the man is on the hill and that was all. " * 3]
    rows = [(i, t) for i, t in enumerate([*foreign, *fine])]
    found = L.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"], evidence=("total", "letters"))
    kept = {r["doc_id"]: r["k"] for r in found.select("doc_id", fits.fits(found["total"], found["letters"]).alias("k")).collect()}
    assert [kept[i] for i, _ in rows] == [False] * 3 + [True] * 5
    every = L.predict(docs, model, ["doc_id"], evidence=("total", "letters"))
    assert every.where(~fits.fits(every["total"], every["letters"])).count() <= docs.count() * 0.002
    assert L.typical(docs.where("false"), model).floor == -np.inf


def test_frames(spark):
    docs = spark.createDataFrame([(1, "the house of the man", "en", 0.5), (2, "la maison de la femme", "fr", 0.1), (3, None, None, None), (None, "the", None, 1.0), (1, "the house of the man", "en", 0.5)], "doc_id long, text string, lang string, score double")
    got = L.predict(docs, L.train(docs), ["doc_id"]).collect()
    assert len(got) == 5 and {r["lang_pred"] for r in got if r["doc_id"] == 2} == {"fr"} and {r["lang_pred"] for r in got if r["doc_id"] == 3} == {"und"}
    nothing = docs.where("false")
    assert L.predict(nothing, L.train(nothing), ["doc_id"]).count() == 0

"""The pipeline, stage by stage, against plain functions on each stage's own input."""

from collections import Counter

import corpus_pipeline as C
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_minhash import brute
from test_secrets import plain

from millrace.llm import langid, secrets
from millrace.llm.common import median


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 456 !!!", "en", "s", 11), (10**6 + 1, None, None, None, None), (10**6 + 2, "my password=hunter2222 and more words here", "en", "s", 42)], docs.schema)
    docs = docs.union(junk)
    kept = C.language(spark, docs, sf)
    before, after = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and {10**6, 10**6 + 1} <= before - after and len(before - after) <= 2 + len(before) * 0.01

    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    single = C.near_duplicates(spark, kept, sf)
    component, _ = brute(texts, 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in component.items() if i == c} and single.columns == docs.columns

    clean = C.secret_scan(spark, single, sf)
    assert clean.schema.names == docs.columns
    old = {r["doc_id"]: r for r in single.collect()}
    for r in clean.collect():
        assert (r["text"] == old[r["doc_id"]]["text"] and r["n_chars"] == old[r["doc_id"]]["n_chars"]) or (r["n_chars"] == len(r["text"]) and "[secret]" in r["text"])
        assert not plain(r["text"])

    packed = C.pack(spark, clean, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}


def test_run(spark, sf):
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "secret_scan", "packing"]
    assert C.run(spark, sf).count() > 0


RARE = "Это предложение написано на другом языке, и оно довольно длинное; beside qzqzqzwx and"


@pytest.fixture(scope="module")
def beyond(spark):
    """6,000 English rows and, with the largest hashes of an id and without id, six in a language of their own."""
    last = [r["id"] for r in spark.range(6000).orderBy(F.xxhash64("id").desc()).limit(5).collect()]
    rows = [(i, RARE if i in last else f"the house of the man is on the hill {i}", "ru" if i in last else "en", "s", 40) for i in range(6000)]
    return spark.createDataFrame([*rows, (None, RARE, "ru", "s", 40)], "doc_id long, text string, lang string, source string, n_chars long")


def test_language_is_learned_from_all_rows(spark, beyond):
    kept = C.language(spark, beyond, "")
    assert kept.count() == 6001 and kept.where("lang = 'ru'").count() == 6
    model = langid.train(beyond, sample_docs=None)
    assert model.langs == ["en", "ru"] and np.allclose(np.exp(model.prior), [5995 / 6001, 6 / 6001])
    found = langid.predict(beyond, model, ["doc_id"], evidence=("total", "letters"))
    total, letters = np.array(found.select("total", "letters").collect(), dtype=np.float64).T
    middle = np.median(total / letters)
    drawn = (total + 50 * middle) / (letters + 50)
    fits = langid.typical(beyond, model)
    assert fits.middle == middle and fits.floor == np.median(drawn) - max(10 * 1.4826 * np.median(abs(drawn - np.median(drawn))), 1.5)


def test_secrets_are_learned_from_all_rows(spark, beyond, monkeypatch):
    used = []
    monkeypatch.setattr(C.secrets, "train", lambda *a, train=secrets.train, **b: used.append(train(*a, **b)) or used[-1])
    assert C.secret_scan(spark, beyond, "").count() == 6001
    built_in = secrets.MarkovScorer.count(secrets.ordinary_samples())
    words = Counter(gram for r in beyond.collect() for w in secrets.WORD.findall(r["text"]) for gram in secrets.MarkovScorer.grams(w))
    got = used[0].sides[1][0]
    assert words["qzq"] == 12 and got["qzq"] == pytest.approx(built_in["qzq"] + 12 * secrets.WEIGHT_DOCS / 6001)
    assert all(got[g] == pytest.approx(built_in[g] + n * secrets.WEIGHT_DOCS / 6001) for g, n in words.items())


def test_sums_that_are_handed_out_early_are_the_same(monkeypatch):
    batches = [{"text": ["the house of", RARE, f"token=abcdef{i} and others"], "lang": ["en", "ru", "en"]} for i in range(4)] + [{"text": [""], "lang": ["en"]}]

    def sums(make):
        add, rest = make()
        parts = [rest() for b in batches if add(b)] + [rest()]
        total = Counter()
        for p in parts:
            for *group, n in zip(*p.values(), strict=True):
                total[tuple(group)] += n
        return len(parts), total

    for module, make in ((langid, lambda: langid._pieces("text", "lang")), (secrets, lambda: secrets._counted("text"))):
        whole = sums(make)
        monkeypatch.setattr(module, "HELD_WORDS", 0)
        parts = sums(make)
        monkeypatch.undo()
        monkeypatch.setattr(module, "HELD_CHARS", 1)
        assert whole[0] == 1 and parts[0] > 4 and sums(make)[0] > 4 and parts[1] == whole[1] == sums(make)[1]
        monkeypatch.undo()


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 7, [1.0, 1.0, 2.0, 2.0], [0.1, 0.2, 1e300, -1e300], list(np.random.default_rng(3).normal(-2, 1e-9, 999)), [*np.random.default_rng(4).random(500), *[0.5] * 300, 1e12, 1e-300]])
def test_median(spark, monkeypatch, values):
    monkeypatch.setattr("millrace.llm.common.BINS", 16)
    got = median(spark.createDataFrame([(float(v),) for v in values], "v double"), F.col("v"))
    assert got == (np.median(values) if values else None)

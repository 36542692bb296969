"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from millrace.llm import minhash as M


def brute(docs, words, percent):
    """{id: component} by comparing all pairs."""
    sets = {}
    for i, t in docs:
        sets.setdefault(i, set(M.shingles(t, words).tolist()))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def corpus(seed=1):
    """Groups of near copies at all distances, exact copies, short, empty and null texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 6)))
    docs = []
    for size in (60, 25, 5, 2, 1):
        base = [word() for _ in range(90)]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [docs[0]] * 10 + ["one two", "One  TWO", "one two three", "", None, "  \n ", "x" * 50_000]
    draw.shuffle(docs)
    return list(enumerate(docs))


def check(spark, settings):
    docs = corpus()
    want, sizes = brute(docs, settings.words, settings.percent)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS id", "text AS bands")
    got = M.near_duplicates(frame, settings).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert {r["id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got) and len(got) == len(docs)


def test_all_pairs(spark):
    check(spark, M.NearSettings(words=3, percent=85))


def test_all_pairs_in_many_small_tiles(spark):
    check(spark, M.NearSettings(words=3, percent=85, block=7, sketches=9))


def test_five_words(spark):
    check(spark, M.NearSettings())


def test_repeated_ids_nulls_and_nothing(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b\tc d"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["id"]), r["component_id"], r["kept"]) for r in M.near_duplicates(frame, M.NearSettings(words=3, percent=85)).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    assert M.near_duplicates(frame.where("false")).count() == 0
    assert sorted(r["doc_id"] for r in M.one_of_each(frame, M.NearSettings(words=3, percent=85)).collect()) == [1, 3]
    assert M.one_of_each(frame.where("false")).count() == 0


def test_one_id_with_several_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda n: " ".join([*base[:n], "x", *base[n + 1 :]])
    rows = [(1, near(0)), (5, near(0)), (5, "quite another text"), (7, near(59)), (7, "alone by itself"), (8, "by itself alone"), (9, "quite another text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    settings = M.NearSettings(words=3, percent=85)
    got = sorted((r["id"], r["component_id"], r["kept"]) for r in M.near_duplicates(frame, settings).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 1, False), (7, 7, True), (8, 8, True), (9, 5, False)]
    kept = sorted(map(tuple, M.one_of_each(frame, settings).collect()))
    assert kept == [(1, near(0)), (5, "quite another text"), (7, "alone by itself"), (8, "by itself alone")]


def test_spread_join(spark):
    from millrace.llm.common import spread_join

    left = spark.range(3000).selectExpr("CASE WHEN id < 1500 THEN 0 ELSE id END AS k", "id AS v")
    right = spark.range(0, 3000, 2).selectExpr("id AS k", "id * 10 AS w")
    counts = left.groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        rows = lambda df: sorted((r["k"], r["v"], r["w"] if r["w"] is not None else -1) for r in df.collect())
        assert rows(spread_join(left, right, "k", "v", counts, 3000, how, least=100)) == rows(left.join(right, "k", how))


def test_query_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(M.OP3_SQL).fetchall()
    got = M.op3_near_duplicates(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_words_are_ascii():
    same = lambda a, b: M.shingles(a, 3).tolist() == M.shingles(b, 3).tolist()
    assert same("A B C D", "a\x0bb\x0cc\rd") and not same("É b c d", "é b c d") and not same("a\xa0b c d", "a b c d")
    assert len(M.shingles("a b a b a b", 3)) == 2 and len(M.shingles("a b", 3)) == 1 and len(M.shingles(" ", 3)) == 0
    assert not same("a b", "a b c")


def test_estimate(spark):
    draw = np.random.default_rng(4)
    rows = []
    for share in (0.0, 0.3, 0.6, 0.85, 1.0):
        both = draw.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        one = lambda: np.unique(np.concatenate([both, draw.integers(0, 2**63, (1000 - len(both)) // 2, dtype=np.uint64)]))
        rows.append((share, M.signature(M.minima(one())).tolist(), M.signature(M.minima(one())).tolist()))
    got = spark.createDataFrame(rows, "share double, a array<long>, b array<long>").select("share", M.estimate("a", "b").alias("e")).collect()
    assert all(abs(r["share"] - r["e"]) < 0.2 for r in got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (7, 7)]
    got = {r["node"]: r["label"] for r in M.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {200: 100, 300: 100}


def tangle(seed=7):
    """Paths, a star, a ring and random edges, in any order and direction, some twice, some from a node to itself."""
    draw = random.Random(seed)
    name = [draw.randrange(-(2**62), 2**62) for _ in range(900)]
    edges = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 420)] + [(i, 500 + (i - 499) % 60) for i in range(500, 560)]
    edges += [(draw.randrange(600, 900), draw.randrange(600, 900)) for _ in range(150)]
    edges = [(name[a], name[b]) if draw.random() < 0.5 else (name[b], name[a]) for a, b in edges + edges[::9]]
    draw.shuffle(edges)
    union = M._Union()
    for a, b in edges:
        union.join(a, b)
    nodes = {x for edge in edges if edge[0] != edge[1] for x in edge}
    groups = {}
    for x in nodes:
        groups.setdefault(union.top(x), []).append(x)
    return edges, {x: min(g) for g in groups.values() for x in g if x != min(g)}


@pytest.mark.parametrize("in_task", [0, 250_000, 527])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, in_task):
    monkeypatch.setattr(M, "EDGES_IN_TASK", in_task)
    edges, want = tangle()
    got = M.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)
    assert M.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_all_pairs_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "EDGES_IN_TASK", 0)
    check(spark, M.NearSettings(words=3, percent=85))


def test_few_edges_take_few_tasks(spark):
    """However many partitions a shuffle has: rounds of joins over a few edges made thousands of tasks, and files for each."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, tracker = {k: spark.conf.get(k) for k in conf}, spark.sparkContext.statusTracker()
    edges = [(i, i + 1) for i in range(50)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-edges", "few-edges")
        got = {r["node"]: r["label"] for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for job in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert got == dict.fromkeys(range(1, 51), 0) and stages and tasks <= 4 * 40

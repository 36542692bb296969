"""Search against brute force."""

import numpy as np

from millrace.llm import ann as A


def brute(rows, k=10):
    """{query: [(distance, id)]} over usable vectors."""
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, dtype=np.float64)
    return {q: sorted((float(np.sqrt(((fine[q] - v) ** 2).sum())), i) for i, v in fine.items() if i != q)[:k] for q in fine if q % 100 == 0}


def compare(spark, rows, least, kind="float", settings=A.TreeSettings()):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "vec_id AS leaf", "1 AS part")
    got: dict = {}
    for r in A.search(frame, 10, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), settings=settings).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    assert set(got) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(s, i) for _, s, i in found] == sorted((s, i) for _, s, i in found) and q not in [i for _, _, i in found]
        hits += len({i for _, _, i in found} & {i for _, i in want[q]})
        total += len(want[q])
    assert hits >= least * total


def test_given_vectors(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    compare(spark, rows, 0.9)


def test_many_leaves_and_parts(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16)) * 4
    rows = [(i, (centres[i % 12] + draw.normal(size=16)).tolist()) for i in range(3000)]
    compare(spark, rows, 0.9, "double", A.TreeSettings(leaf_rows=32, part_queries=3))


def test_leaves_grow_with_the_table(spark):
    """Ten times the sample, in one cloud and in clumps: leaves are split, some twice."""
    draw = np.random.default_rng(4)
    clump = lambda i: np.zeros(8) if i % 2 else np.full(8, 6.0 + i % 3)
    rows = [(i, (clump(i) + draw.normal(size=8)).tolist()) for i in range(5000)]
    settings = A.TreeSettings(sample_rows=500, leaf_rows=100, leaf_most=60, split_sample=300, split_branches=6, part_queries=4)
    compare(spark, rows, 0.9, "float", settings)
    index = spark.createDataFrame([(v, [i], False, "0") for i, v in rows], "v array<double>, ids array<long>, q boolean, leaf string")
    from millrace.llm.common import cut

    index, splits = A.grown(cut(index), 10, 5000, settings)
    sizes = [r["count"] for r in index.groupBy("leaf").count().collect()]
    assert len(splits) >= 3 and max(sizes) <= 60 and sum(sizes) == 5000


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 700, 7)] + [(i, [1.0, float(i % 3)]) for i in range(1, 300, 2) if i % 7]
    compare(spark, rows, 1.0)


def test_unusable_vectors_take_no_part(spark):
    bad = [(100, None), (200, [0.0, 0.0]), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])]
    compare(spark, bad + good, 1.0)
    compare(spark, [(0, [1.0])], 1.0)
    compare(spark, bad, 1.0)


def test_traversal_visits_every_leaf_once():
    rows = np.random.default_rng(3).normal(size=(2000, 8))
    tree = A.KMeansTree(rows, A.TreeSettings())
    assert sorted(tree.best_bins(rows[0])) == list(range(tree.leaves)) and next(iter(tree.best_bins(rows[0]))) == tree.leaf_of(rows[:1])[0]
    assert set(tree.leaf_of(rows)) <= set(range(tree.leaves))

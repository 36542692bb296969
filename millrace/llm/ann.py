"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (`sample_rows`, those with the smallest hashes) and every row is put into
one of its leaves. Leaves that hold more than `leaf_most` rows of the table grow another level, and so on: each is split by
k-means on a bounded sample of its own rows, in the executors. So leaves stay as small in a table of any size, and a
query's work does not grow with the table.

A query visits leaves through a priority queue of branches, nearest centre first. How many it visits is
calibrated: on queries from the sample the number is widened until recall against brute force over the sample reaches
`recall`. In a leaf that was split it goes on to the nearest of its children, to so many as were found in the same way, with
`split_recall`, on the leaf's sample (and so many that they hold k + 1 rows). Queries of a leaf that many visit are dealt to parts.

Equal vectors are one row of the index with its smallest ids: as equal distances are ordered by id, only the first
k + 1 ids of a vector can be among a query's k nearest, so results are the same, and a vector that a third
of all rows share is compared once.

Distances are Euclidean, in double precision on the original vectors. Defined results: vectors that are null, of
another length than most of the sample's, zero, or hold null or non-finite components take no part, neither as
query nor as candidate. Fewer than k candidates: all are returned. Rows repeated with one id count as that id once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, cut, release, spread_join, table


@dataclass(frozen=True)
class TreeSettings:
    sample_rows: int = 20_000
    branches: int = 8
    leaf_rows: int = 64  # of the sample
    recall: float = 0.96
    queries: int = 200  # of the calibration
    leaf_most: int = 4096  # rows of the table; a leaf with more is split
    split_sample: int = 2048  # of a leaf's rows, about
    split_branches: int = 32
    split_recall: float = 0.99
    part_queries: int = 1024


def k_means(rows: np.ndarray, k: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centres, the number of each row's), without empty ones."""
    centres = rows[draw.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(8):
        which = squares(rows, centres).argmin(axis=1)
        used = np.unique(which)
        centres = np.stack([rows[which == c].mean(axis=0) for c in used])
    which = squares(rows, centres).argmin(axis=1)
    used, which = np.unique(which, return_inverse=True)
    return centres[used], which


class KMeansTree:
    """Centres by node; a node's children are given by number, leaves by -1 - leaf."""

    def __init__(self, sample: np.ndarray, s: TreeSettings) -> None:
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.draw = np.random.Generator(np.random.PCG64(5))
        self.top = self._grow(sample.astype(np.float64), s)
        del self.draw

    def _grow(self, rows: np.ndarray, s: TreeSettings) -> int:
        if len(rows) > s.leaf_rows:
            centres, which = k_means(rows, s.branches, self.draw)
            if len(centres) > 1:
                node = len(self.centres)
                self.centres.append(centres)
                self.children.append([])
                for c in range(len(centres)):
                    child = self._grow(rows[which == c], s)
                    self.children[node].append(child)
                return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre at every node."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(self.top, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
            elif len(at):
                which = squares(rows[at], self.centres[node]).argmin(axis=1)
                todo += [(child, at[which == c]) for c, child in enumerate(self.children[node])]
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first traversal."""
        queue = [(0.0, self.top)]
        while queue:
            _, node = heapq.heappop(queue)
            while node >= 0:
                d = ((self.centres[node] - query) ** 2).sum(axis=1)
                best = int(d.argmin())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        heapq.heappush(queue, (float(d[c]), child))
                node = self.children[node][best]
            yield -node - 1


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)


def calibrated_visits(tree: KMeansTree, sample: np.ndarray, k: int, s: TreeSettings) -> int:
    """The least number of leaves, of a widening series, at which sample queries reach the recall."""
    leaf = tree.leaf_of(sample)
    queries = sample[:: max(1, len(sample) // s.queries)][: s.queries]
    d = squares(queries, sample)
    d[np.arange(len(queries)), np.arange(len(queries)) * max(1, len(sample) // s.queries)] = np.inf  # not the query itself
    truth = np.argpartition(d, min(k, len(sample)) - 1, axis=1)[:, :k]
    rank = np.full((len(queries), tree.leaves), tree.leaves)
    for i, q in enumerate(queries):
        for n, x in enumerate(tree.best_bins(q)):
            rank[i, x] = n
    needed = np.take_along_axis(rank, leaf[truth], axis=1)
    for visits in sorted({*(int(1.15**i) for i in range(1, 120)), tree.leaves}):
        if visits >= tree.leaves or (needed < visits).mean() >= s.recall:
            return min(visits, tree.leaves)
    return tree.leaves


def split_of(rows: np.ndarray, k: int, s: TreeSettings) -> tuple[np.ndarray, int]:
    """Centres of a leaf's children, and how many of them a query visits."""
    centres, which = k_means(rows, s.split_branches, np.random.Generator(np.random.PCG64(6)))
    at = np.arange(0, len(rows), max(1, len(rows) // s.queries))
    d = squares(rows[at], rows)
    d[np.arange(len(at)), at] = np.inf  # not the query itself
    truth = np.argpartition(d, min(k, len(rows) - 1) - 1, axis=1)[:, :k]
    rank = squares(rows[at], centres).argsort(axis=1).argsort(axis=1)
    needed = np.take_along_axis(rank, which[truth], axis=1)
    widen = next(w for w in range(1, len(centres) + 1) if w == len(centres) or (needed < w).mean() >= s.split_recall)
    fewest = np.sort(np.bincount(which)).cumsum()  # rows of the sample in the smallest children
    return centres, max(widen, min(len(centres), int(np.searchsorted(fewest, k + 1)) + 1))


def distances(v: F.Column, centres: F.Column) -> F.Column:
    """Squared distance to each centre."""
    return F.transform(centres, lambda c: F.aggregate(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x))


def grown(index: DataFrame, k: int, rows: int, s: TreeSettings) -> tuple[DataFrame, list[DataFrame]]:
    """(index with leaves of bounded size, the splits that led there: leaf, centres, widen of each level)."""
    splits: list[DataFrame] = []

    def fit(leaf: tuple, some: pd.DataFrame) -> pd.DataFrame:
        centres, widen = split_of(np.stack(some["v"].to_list()).astype(np.float64), k, s)
        found = [(leaf[0], centres.tolist(), widen)] if len(centres) > 1 else []
        return pd.DataFrame(found, columns=["leaf", "centres", "widen"])

    while True:
        big = cut(index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.leaf_most), "big")
        if big.isEmpty():
            return index, splits
        first = F.col("ids")[0]
        known = spread_join(index.withColumn("id", first), big, "leaf", "id", big, rows)
        some = known.where(F.pmod(F.xxhash64("id", F.lit(9)), F.ceil(F.col("n") / s.split_sample)) == 0)
        split = cut(some.select("leaf", "v").groupBy("leaf").applyInPandas(fit, "leaf string, centres array<array<double>>, widen int"), "split")
        if split.isEmpty():
            return index, splits
        splits.append(split)
        placed = spread_join(index.withColumn("id", first), split.select("leaf", "centres"), "leaf", "id", big, rows, "left").withColumn("d", distances(F.col("v"), F.col("centres")))
        child = F.concat_ws(".", "leaf", F.array_position("d", F.array_min("d")).cast("string"))
        before, index = index, cut(placed.select("v", "ids", "q", F.when(F.col("centres").isNull(), F.col("leaf")).otherwise(child).alias("leaf")), "index")
        release(before)


def usable(vector: str) -> F.Column:
    """Not null, not zero, all components present and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector)
    return F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def search(rows: DataFrame, k: int, is_query: F.Column, key: str = "vec_id", vector: str = "embedding", settings: TreeSettings = TreeSettings()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, the k nearest found of all other rows."""
    s, spark = settings, rows.sparkSession
    bounded_batches(spark)
    given = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable("v"))
    sample = [(r["v"]) for r in given.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(s.sample_rows).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths, often = np.unique([len(v) for v in sample], return_counts=True)
    dim = int(lengths[often.argmax()])
    known = np.unique(np.array([v for v in sample if len(v) == dim], dtype=np.float64), axis=0)
    tree = KMeansTree(known, s)
    visits = calibrated_visits(tree, known, k, s)
    shipped = spark.sparkContext.broadcast(tree)  # bounded by the sample: at most as many numbers

    # one row for each vector: its k + 1 smallest ids, gathered in two steps so that no group is large
    given = given.where(F.size("v") == dim)
    size = rows.count()
    salts = max(1, math.ceil(size / 20_000))
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    first = given.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(smallest(F.collect_list("id")).alias("ids"), F.max("q").alias("q"))
    vectors = first.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("q").alias("q"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shipped.value.leaf_of(as_matrix(b.column(0), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(str, leaf.tolist()), type=pa.string())], names=["v", "ids", "q", "leaf"])

    kind = dict(given.dtypes)["v"]
    index = cut(vectors.select("v", "ids", "q").mapInArrow(put, f"v {kind}, ids array<bigint>, q boolean, leaf string"), "index")
    counts = {int(r["leaf"]): r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a leaf of the sample's tree
    index, splits = grown(index, k, size, s)
    asked = index.where("q")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query", "v", "leaf"])
        for b in batches:
            for vid, v in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                seen = met = 0
                for leaf in shipped.value.best_bins(np.array(v, dtype=np.float64)):
                    seen, met = seen + 1, met + counts.get(leaf, 0)
                    if leaf in counts:
                        out.append((vid[0], v, str(leaf)))
                    if seen >= visits and met > k:
                        break
                if len(out) >= 5000:
                    yield made()
                    out.clear()
        if out:
            yield made()

    kinds = [pa.int64(), pa.list_(pa.float64() if kind == "array<double>" else pa.float32()), pa.string()]
    visited = asked.select("v", "ids").mapInArrow(visit, f"query long, v {kind}, leaf string")
    for split in splits:  # on to the nearest children
        visited = cut(visited, "visited")
        load = visited.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        met = spread_join(visited, split, "leaf", "query", load, visited.count(), "left")
        near = F.transform(F.slice(F.array_sort(F.transform(distances(F.col("v"), F.col("centres")), lambda d, i: F.struct(d.alias("d"), (i + 1).alias("i")))), 1, F.col("widen")), lambda x: F.concat_ws(".", "leaf", x["i"].cast("string")))
        visited = met.select("query", "v", F.explode(F.when(F.col("centres").isNull(), F.array("leaf")).otherwise(near)).alias("leaf"))
    visited = cut(visited, "visited")
    load = cut(visited.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "load")
    ways = load.select("leaf", F.ceil(F.col("n") / s.part_queries).cast("int").alias("ways"))
    visited = spread_join(visited, ways, "leaf", "query", load, visited.count()).withColumn("part", F.pmod(F.xxhash64("query"), F.col("ways")).cast("int"))
    candidates = index.select("v", "ids", "leaf").join(ways, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    on = ["leaf", "part"]

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, float, int]] = []
        if len(left) and len(right):
            rows_ = np.stack(right["v"].to_list()).astype(np.float64)
            ids = right["ids"].to_list()
            for at in range(0, len(left), 256):
                ask = np.stack(left["v"].iloc[at : at + 256].to_list()).astype(np.float64)
                rough = squares(ask, rows_)
                most = np.partition(rough, min(k, len(rows_) - 1), axis=1)[:, min(k, len(rows_) - 1)]
                slack = 1e-9 * ((ask * ask).sum(axis=1) + (rows_ * rows_).sum(axis=1).max())
                for i, query in enumerate(left["query"].iloc[at : at + 256]):
                    near = np.flatnonzero(rough[i] <= most[i] + slack[i])
                    exact = np.sqrt(((rows_[near] - ask[i]) ** 2).sum(axis=1))
                    all_ = sorted((float(d), int(x)) for d, j in zip(exact, near, strict=True) for x in ids[j])[: k + 1]
                    found += [(int(query), d, x) for d, x in all_]
        return pd.DataFrame(found, columns=["query", "d", "id"])

    tiles = visited.select("query", "v", *on).groupBy(*on).cogroup(candidates.select("v", "ids", *on).groupBy(*on)).applyInPandas(nearest, "query long, d double, id long")
    # a query has k + 1 for each leaf that it visits
    best = tiles.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("best"))
    # every id of a query's vector gets its own list, without itself
    asking = given.where("q").select(F.col("id").alias("query_id"), "v").distinct()
    named = asking.join(asked.select("v", F.col("ids")[0].alias("query")), "v").select("query_id", "query").join(best, "query")
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of all other rows of embeddings, for rows whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, 10, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))

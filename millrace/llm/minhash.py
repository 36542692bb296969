"""MinHash near-duplicates: b-bit signatures, band candidates, exact links, components.

1. Each text gives its set of word shingles as 64-bit hashes, its size, a digest of the set, and from 128 minima
   of hash functions 32 band keys (four minima each) and a b-bit signature: the lowest two bits of each minimum,
   packed by bit plane into four 64-bit words. Two sets of similarity 0.85 (0.8) share no band key with probability
   6e-11 (5e-8).
2. Texts with one set are one node, whatever their ids. Only nodes go on, so copies cost nothing more.
3. In each bucket of a band every node is paired with the bucket's smallest. The signatures' agreement, a bit count,
   corrected for chance collisions, estimates a pair's similarity; pairs that are at least `slack` (more than six
   standard deviations) below the threshold go. The rest is confirmed on the full sets, and confirmed links are joined to components.
4. Buckets whose other nodes are of several components may still hide a link. Their nodes are dealt to blocks, and pairs of
   blocks to "tiles", which compare signatures alone, and give every node's best pair across components and a spanning
   forest of all such pairs that pass the estimate. These pairs, about two for a node, are confirmed; while a tenth of them are links,
   which join components, this is done again.
5. What is left: families are what the last forest joins, so band keys that agree by chance make none. A family is dealt to
   tiles in the same way, which compare full sets and give a spanning forest of the links. Two blocks of one large
   component aren't compared, so a component of many nodes costs only its comparison with what it isn't linked with yet.
6. Components of all links together, each named by its smallest id.

Links between two texts are lost only if they share no band key, or by the slack. No group is collected: buckets, components
and families are dealt with by partial minima and joins that spread hot keys (`spread_join`); a tile is bounded.
Nothing but counts and hot keys, a bounded number, reaches the driver.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing. A text with fewer
words than a shingle has one shingle, its whole sequence. Repeated rows get the same component. Rows that share an id but not
the text are judged each by its own text. A null id is linked with nothing: null component, kept. Empty tables
give empty results. `one_of_each` keeps one row of every group, also of repeated rows and of rows without id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, cut, release, spread_join, table, tidy

HASHES, BANDS, BITS = 128, 32, 2
ROWS = HASHES // BANDS

#: So many edges are joined to components in one task (two numbers each, and a row of a dictionary for each node).
EDGES_IN_TASK = 250_000


@dataclass(frozen=True)
class NearSettings:
    words: int = 5  # in a shingle
    percent: int = 80  # least similarity: intersection over union
    slack: float = 0.25  # an estimate so much below the threshold is no candidate
    block: int = 128  # nodes of a family in one block
    sketches: int = 2048  # nodes of a bucket in one block


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240229))
    return draw.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1), draw.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


_MULTIPLY, _PLACE = _constants()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles. Bytes' lower() and split() know ASCII only."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=np.uint64)
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = _mixed(total + h[i : len(h) - size + 1 + i] * _PLACE[i % 64])
    return np.unique(total)


def minima(hashes: np.ndarray) -> np.ndarray:
    """128 minima of 32-bit hash functions; hashes are taken in parts of bounded memory."""
    least = np.full(HASHES, 2**32 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 2048):
        part = (_MULTIPLY[:, None] * hashes[None, i : i + 2048]) >> np.uint64(32)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = least.reshape(BANDS, ROWS)
    key = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[0])
    for i in range(ROWS):
        key = _mixed(key + rows[:, i] * _PLACE[i + 1])
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """Bit planes of the lowest BITS bits of the minima, 64 minima in a word."""
    planes = [np.packbits((least >> np.uint64(b)) & np.uint64(1) > 0, bitorder="little").view(np.int64) for b in range(BITS)]
    return np.concatenate(planes)


def features(documents: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, set_id, bands array<long>, signature array<long> of every document, and row, a number of its own."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("bands", longs), ("signature", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            least = [minima(s) for s in sets]
            columns = [
                batch.column(0).cast(pa.int64()),
                [len(s) for s in sets],
                list(map(set_digest, sets)),
                [band_keys(m) if len(s) else None for m, s in zip(least, sets, strict=True)],
                [signature(m) if len(s) else None for m, s in zip(least, sets, strict=True)],
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        tidy()

    bounded_batches(documents.sparkSession)
    found = documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, "id long, n long, set_id binary, bands array<long>, signature array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, shingles array<long> of the rows (text, node, set_id) whose text has the set."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            same = [i for i, (s, d) in enumerate(zip(sets, batch.column(2).to_pylist(), strict=True)) if set_digest(s) == d]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(same, type=pa.int64())), pa.array([sets[i].view(np.int64) for i in same], type=schema.field(1).type)], schema=schema)
        tidy()

    bounded_batches(texts.sparkSession)
    return texts.select("text", "node", "set_id").mapInArrow(run, "node long, shingles array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity by the agreement of two signatures, corrected for chance: (m - C) / (1 - C), C = 2^-BITS."""
    half = HASHES // 64
    differ = F.lit(0)
    for word in range(half):
        bits = F.lit(0).cast("long")
        for plane in range(BITS):
            at = plane * half + word
            bits = bits.bitwiseOR(F.col(a)[at].bitwiseXOR(F.col(b)[at]))
        differ = differ + F.bit_count(bits)
    agree = 1 - differ / HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component for every node of an edge (a, b) but the smallest itself.

    At most EDGES_IN_TASK edges are joined in one task. More of them alternate large-star and small-star steps until nothing
    changes or so few are left: each node's larger neighbours are linked to its smallest, then each node's smaller neighbours and
    itself. Rounds grow with the logarithm of the longest path; each is some eleven shuffles, however few edges there are.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        check = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (check["n"], check["h"]) == state or not check["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        if check["n"] <= EDGES_IN_TASK:
            labels = cut(in_one_task(now), "labels")
            release(now)
            return labels
        state = (check["n"], check["h"])
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = now.union(up).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(up, least, "a", "b", up.groupBy("a").agg(F.count(F.lit(1)).alias("n")), check["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        before, now = now, cut(small.distinct(), "edges")
        release(before)


def in_one_task(edges: DataFrame) -> DataFrame:
    """components() of so few edges that a task can hold them."""
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        sets = _Union()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.join(a, b)
        nodes = list(sets.above)  # all but the smallest of each
        yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(map(sets.top, nodes), type=pa.int64())], schema=schema)
        del sets, nodes
        tidy()

    bounded_batches(edges.sparkSession)
    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `comp`: the label of `node`, or itself. A node has a bounded number of rows."""
    return rows.join(labels.withColumnRenamed("label", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def in_tiles(members: DataFrame, block: int) -> DataFrame:
    """family, node, comp -> the same with the tile (low, high): every two nodes of a family in different components meet in a tile.

    Components of at least `block` nodes have blocks of their own; smaller ones share blocks by their hash. A tile is
    a pair of blocks (or one with itself), but not two of one large component, nor one of these with itself.
    members is a written table.
    """
    total = members.count()
    sizes = cut(members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(n / block).cast("long") - 1)
    at = lambda of, k: F.struct(of.alias("of"), k.alias("k"))
    large = sizes.where(F.col("n") >= block).select("family", "comp", F.explode(upto(F.col("n"))).alias("k")).select("family", at(F.col("comp"), F.col("k")).alias("at"))
    rest = sizes.where(F.col("n") < block).groupBy("family").agg(F.sum("n").alias("rest"))
    shared = rest.select("family", F.explode(upto(F.col("rest"))).alias("k")).select("family", at(F.lit(None).cast("long"), F.col("k")).alias("at"))
    blocks = large.union(shared).groupBy("family").agg(F.collect_list("at").alias("others")).join(rest, "family", "left")
    placed = spread_join(members, sizes, ["family", "comp"], "node", sizes, total)
    placed = spread_join(placed, blocks, "family", "node", sizes.groupBy("family").agg(F.sum("n").alias("n")), total)
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)).cast("long")
    among = F.pmod(F.xxhash64("comp"), F.ceil(F.col("rest") / block)).cast("long")
    is_large = F.col("n") >= block
    placed = placed.withColumn("at", at(F.when(is_large, F.col("comp")), F.when(is_large, own).otherwise(among)))
    met = placed.withColumn("other", F.explode("others"))
    same_large = F.col("at.of").isNotNull() & F.col("at.of").eqNullSafe(F.col("other.of"))
    return met.where(~same_large).select("family", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "node", "comp")


def by_tile(tiles: DataFrame, what: DataFrame, find: Callable[[pd.DataFrame], list[tuple[int, int]]], in_task: int) -> DataFrame:
    """a, b: what find() gives for each tile's nodes with their row of `what`. Tiles are many and small, so a call to Python gets some of them, of about `in_task` rows."""
    tiles = cut(tiles.select(F.xxhash64("family", "low", "high").alias("tile"), "node", "comp"), "tiles")
    calls = max(1, tiles.count() // in_task)

    def work(some: pd.DataFrame) -> pd.DataFrame:
        out = [pair for _, tile in some.groupby("tile", sort=False) for pair in find(tile.reset_index(drop=True))]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return tiles.join(what, "node").withColumn("call", F.pmod("tile", F.lit(calls))).groupBy("call").applyInPandas(work, "a long, b long")


class _Union:
    """Union-find over any numbers."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        p, q = self.top(a), self.top(b)
        if p != q:
            self.above[max(p, q)] = min(p, q)
        return p != q


def likely_pairs(rows: pd.DataFrame, least: float) -> list[tuple[int, int]]:
    """Of the pairs of nodes in different components whose signatures' estimate is at least so much: a spanning forest, and every node's best."""
    rows = rows.drop_duplicates("node", ignore_index=True)
    n, planes, half, chance = len(rows), np.stack(rows["signature"].to_list()), HASHES // 64, 2.0**-BITS
    comp, nodes = rows["comp"].to_numpy(), rows["node"].to_numpy()
    likely, best = np.zeros((n, n), dtype=bool), np.zeros(n, dtype=np.int64)
    for low in range(0, n, 256):
        some = slice(low, low + 256)
        differ = np.zeros((len(comp[some]), n), dtype=np.int64)
        for word in range(half):
            bits = np.zeros(differ.shape, dtype=np.int64)
            for plane in range(BITS):
                x = planes[:, plane * half + word]
                bits |= x[some, None] ^ x[None, :]
            differ += np.bitwise_count(bits)
        likely[some] = ((1 - differ / HASHES - chance) / (1 - chance) >= least) & (comp[some, None] != comp[None, :])
        best[some] = np.where(likely[some], differ, HASHES + 1).argmin(axis=1)
    todo = likely.any(axis=1)
    pairs = [(i, int(best[i])) for i in np.flatnonzero(todo).tolist()]
    for start in np.flatnonzero(todo).tolist():
        reached = [start] if todo[start] else []
        while reached:
            i = reached.pop()
            todo[i] = False
            new = np.flatnonzero(likely[i] & todo).tolist()
            todo[new] = False
            pairs += [(i, j) for j in new]
            reached += new
    return [(int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))) for i, j in pairs]


def forest(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among the rows (node, comp, shingles) of a tile, between different components."""
    rows = rows.drop_duplicates("node", ignore_index=True)
    n = len(rows)
    sizes = rows["shingles"].map(len).to_numpy()
    flat = np.concatenate(rows["shingles"].to_list()) if n else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[which] > 1
    column = (np.cumsum(often > 1) - 1)[which[shared]]
    owner, width = owner[shared], int((often > 1).sum())
    common = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, width, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((n, min(4096, width - low)), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    comp, nodes, joined = rows["comp"].to_numpy(), rows["node"].tolist(), _Union()
    links = (100 * common >= percent * union) & (common > 0) & (comp[:, None] != comp[None, :])
    return [(nodes[i], nodes[j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(links))), strict=True) if joined.join(int(comp[i]), int(comp[j]))]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; a written table) whose full sets are similar enough."""
    full = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"x_{c}"))
    both = spread_join(pairs.join(full("b"), "b"), full("a"), "a", "b", pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), pairs.count())
    both = both.withColumn("common", F.size(F.array_intersect("x_a", "x_b")))
    return both.where(F.col("common") * 100 >= percent * (F.size("x_a") + F.size("x_b") - F.col("common"))).select("a", "b")


def unrepeated(documents: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """documents without rows that repeat an id with its text; only ids that repeat are grouped."""
    again = cut(known.where("n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND id IS NOT NULL").select(F.col("id").alias(key)), "again")
    if again.isEmpty():
        return documents
    return documents.join(again, key, "left_anti").union(documents.join(again, key, "left_semi").dropDuplicates([key, text]))


def near_duplicates(documents: DataFrame, settings: NearSettings = NearSettings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of documents."""
    s = settings
    documents = documents.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    known = cut(features(documents, s.words, "doc"), "features")
    rows = known.count()
    # a node is a set: the number of one of its rows; rep is the smallest id that has it
    reps = cut(known.where("n > 0 AND id IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("node"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
    nodes = known.join(reps.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    centers = cut(banded.groupBy("bucket").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"), "centers")
    buckets = cut(spread_join(banded, centers.select("bucket", "center"), "bucket", "node", centers, BANDS * rows), "buckets")
    in_buckets = nodes.select("node", "set_id", F.col("id").alias("doc"), "signature").join(buckets.select("node").distinct(), "node", "left_semi")
    in_buckets = cut(in_buckets, "nodes")
    texts = unrepeated(documents, known, "doc", "text").join(in_buckets.select("doc", "node", "set_id"), "doc")
    sets = cut(full_sets(texts, s.words), "sets")

    # stars: every node with the smallest of each of its buckets
    pairs = cut(buckets.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    side = lambda c: in_buckets.select(F.col("node").alias(c), F.col("signature").alias(f"s_{c}"))
    likely = spread_join(pairs.join(side("b"), "b"), side("a"), "a", "b", pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), pairs.count())
    likely = cut(likely.where(estimate("s_a", "s_b") >= s.percent / 100 - s.slack).select("a", "b"), "likely")
    stars = cut(confirmed(likely, sets, s.percent), "links")
    links, labels = stars, components(stars)

    # what stars can't tell: links between nodes of a bucket that are not its smallest and are in different components
    least, percent = s.percent / 100 - s.slack, s.percent
    while True:
        placed = cut(labelled(buckets.where("node <> center").select("bucket", "node"), labels), "placed")
        mixed = cut(placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 <> c1").select("bucket", "n"), "mixed")
        open_ = cut(spread_join(placed, mixed.select("bucket"), "bucket", "node", mixed, BANDS * rows).withColumnRenamed("bucket", "family"), "open")
        maybe = cut(by_tile(in_tiles(open_, s.sketches), in_buckets.select("node", "signature"), lambda tile: likely_pairs(tile, least), 50_000).distinct(), "maybe")
        found, asked = cut(confirmed(maybe, sets, s.percent), "links"), maybe.count()
        if (right := found.count()):
            links = links.union(found)
            labels = components(links)
        if right * 10 <= asked:
            break
    family = components(maybe).withColumnRenamed("label", "family")
    ends = maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = cut(labelled(ends, labels).join(family, "node", "left").withColumn("family", F.coalesce("family", "node")), "members")
    more = by_tile(in_tiles(members, s.block), sets, lambda tile: forest(tile, percent), 4_000)
    final = components(links.union(more))

    # the smallest id of each component, for each set and then each row
    members = cut(final.union(final.select(F.col("label").alias("node"), "label").distinct()).join(reps.drop("n"), "node"), "components")
    smallest = members.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    smallest = cut(smallest, "smallest")
    of_set = spread_join(members, smallest.drop("n"), "label", "node", smallest, rows).select("set_id", "component_id")
    of_set = reps.select("set_id", "rep").join(of_set, "set_id", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"))
    own = known.where("id IS NOT NULL").select("id", F.col("n").alias("n_shingles"), "set_id", "row")
    out = spread_join(own, of_set, "set_id", "row", reps.select("set_id", "n"), rows, "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("id") == F.col("component_id"))
    return out.union(known.where("id IS NULL").select("id", "n", "id", F.lit(True)))


def one_of_each(documents: DataFrame, settings: NearSettings = NearSettings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents, one of each group of near-duplicates: the one with the smallest key (then null ones, then of repeated rows any)."""
    size = documents.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(f"`{key}`")).alias("keys")).first()
    if size["n"] == size["keys"]:
        dropped = near_duplicates(documents, settings, key, text).where(~F.col("kept")).select(F.col("id").alias(key))
        return documents.join(dropped, key, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
    # a key repeats or is null: rows get numbers of their own
    numbered = cut(documents.withColumn("near_number", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, settings, "near_number", text).select(F.col("id").alias("near_number"), "component_id")
    order = F.struct(F.col(f"`{key}`").isNull().alias("last"), F.col(f"`{key}`").alias("key"), F.col("near_number").alias("number"))
    kept = numbered.select("near_number", order.alias("place")).join(found, "near_number").groupBy("component_id").agg(F.min("place").alias("first"))
    return numbered.join(kept.select(F.col("first.number").alias("near_number")), "near_number", "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and whether it is kept of every row of documents: 3 words, similarity 0.85."""
    found = near_duplicates(table(spark, sf_dir, "documents"), NearSettings(words=3, percent=85))
    return found.withColumnRenamed("id", "doc_id")


#: Every link of all pairs of documents that share a shingle. Ids are unique.
OP3_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN list_aggregate(w, 'string_agg', ' ') ELSE list_aggregate(w[i : i + 2], 'string_agg', ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
smallest AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(c, d.doc_id), d.doc_id) AS component_id, coalesce(c, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN smallest ON smallest.doc_id = d.doc_id
"""

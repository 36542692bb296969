"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A leaf is a sentence (or a part of 200 characters of a longer one) with what ends it, so the leaves joined
are the text. The leaves up to a line break are a paragraph. A section ends after a blank line or after a
paragraph whose hash says so (one in eight), so an edit does not move the sections after it. A node's hash
is the hash of its children's; equal roots mean equal texts, and where hashes differ, the branch leads to
the edit (`differences`, the column `changed`: paragraphs that the edited text lacks). A fingerprint is a string: the root, then the leaves' hashes, with `,` between
paragraphs and `;` between sections; inner hashes follow from it. The likeness of two fingerprints is
the Dice coefficient of their leaves as multisets (two empty texts: 1), found by going down from the roots into what differs.

Defined results: a null text counts as empty; the empty text has a root and no leaves. Repeated rows (also
of one doc_id) give one result each, in the order of doc_id, null ids first. A table of one row is its own next.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, bounded_batches, map_rows, table

LEAF = re.compile(r"[^.!?\n]{1,200}(?:[.!?]+ ?)?\n?|[.!?]+ ?\n?|\n")
LEAF_HEX = 12


def digest(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=LEAF_HEX // 2).hexdigest()


def leaf_hashes(text: str, known: dict[str, str]) -> list[tuple[str, bool]]:
    """(hash, whether the leaf ends its paragraph) of each leaf; known: hashes of leaves met before."""
    out = []
    for leaf in LEAF.findall(text):
        h = known.get(leaf)
        if h is None:
            h = known[leaf] = digest(leaf.encode("utf-8", "surrogatepass"))
        out.append((h, leaf[-1] == "\n"))
    return out


def fingerprint(text: str | None, known: dict[str, str] | None = None) -> str:
    """root:leaves, in paragraphs and sections."""
    sections: list[list[str]] = [[]]
    paragraph: list[str] = []
    blank = digest(b"\n")
    for h, ends in [*leaf_hashes(text or "", {} if known is None else known), ("", True)]:
        paragraph.append(h)
        if ends:
            joined = "".join(paragraph)
            if joined:
                sections[-1].append(joined)
                if joined == blank or int(digest(joined.encode())[:2], 16) % 8 == 0:
                    sections.append([])
            paragraph = []
    shown = ";".join(",".join(s) for s in sections if s)
    return f"{root(shown)}:{shown}"


def root(leaves: str) -> str:
    """The root hash of the part of a fingerprint after `:`."""
    tops = [digest("".join(digest(p.encode()) for p in s.split(",")).encode()) for s in leaves.split(";")]
    return hashlib.blake2b("".join(tops).encode(), digest_size=16).hexdigest()


def leaves(print_: str) -> list[str]:
    flat = print_.partition(":")[2].replace(",", "").replace(";", "")
    return [flat[i : i + LEAF_HEX] for i in range(0, len(flat), LEAF_HEX)]


def branches(print_: str, sep: str) -> Counter:
    return Counter(print_.partition(":")[2].split(sep))


def common_leaves(a: str, b: str) -> int:
    """How many leaves two fingerprints share, as multisets. Goes down from the roots: a branch that both have counts as a whole,
    and only what is left of either is opened."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return len(leaves(a))
    x, y, same = branches(a, ";"), branches(b, ";"), 0
    for sep in (",", ""):
        both = x & y
        same += sum(n * (len(branch) - branch.count(",")) // LEAF_HEX for branch, n in both.items())
        x, y = opened(x - both, sep), opened(y - both, sep)
    return same + (x & y).total()


def opened(some: Counter, sep: str) -> Counter:
    """The children of branches, as often as they occur: paragraphs of sections, or (without a separator) leaves of paragraphs."""
    out: Counter = Counter()
    for branch, n in some.items():
        for child in branch.split(sep) if sep else [branch[i : i + LEAF_HEX] for i in range(0, len(branch), LEAF_HEX)]:
            out[child] += n
    return out


def likeness(a: str, b: str) -> float:
    """2 x common leaves / all leaves, between 0 and 1; equal fingerprints: 1."""
    if a == b:
        return 1.0
    return 2 * common_leaves(a, b) / (size_of(a) + size_of(b))


def size_of(print_: str) -> int:
    """How many leaves there are."""
    inner = len(print_) - print_.index(":") - 1
    return (inner - print_.count(",") - print_.count(";")) // LEAF_HEX


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of a, from 0, of the paragraphs that b lacks: only differing branches are followed."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    sections, paragraphs = branches(b, ";"), Counter(b.partition(":")[2].replace(";", ",").split(","))
    out = []
    for i, section in enumerate(a.partition(":")[2].split(";")):
        if sections[section] > 0:  # the same branch: nothing below differs
            sections[section] -= 1
            continue
        out += [(i, j) for j, p in enumerate(section.split(",")) if p and not paragraphs[p]]
    return out


def ranges(found: list[tuple[int, int]]) -> str:
    """`section.paragraph` of each difference, neighbours of one section as `section.first-last`, joined by commas."""
    out: list[list[int]] = []
    for i, j in found:
        if out and out[-1][0] == i and out[-1][2] == j - 1:
            out[-1][2] = j
        else:
            out.append([i, j, j])
    return ",".join(f"{i}.{a}" if a == b else f"{i}.{a}-{b}" for i, a, b in out)


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of every text."""
    kind = dict(documents.select(F.col(f"`{key}`")).dtypes)[key]
    return map_rows(documents, [key, text], f"`{key}` {kind}, fingerprint string", lambda: lambda batch: {key: batch[key], "fingerprint": [fingerprint(t) for t in batch[text]]})


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed string"


def compared(doc_id: int | None, text: str, own: str, known: dict[str, str], next_text: str, next_print: str) -> tuple:
    """One row of the result."""
    quarter = len(text) // 4
    edited = text[: len(text) - quarter] + next_text[:quarter]
    changed = fingerprint(edited, known)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_print), ranges(differences(own, changed))


def with_next(documents: DataFrame, rows_per_block: int = 2000, most_blocks: int = 20_000) -> DataFrame:
    """Each text compared with its edited text and its next, in the order of doc_id (column doc_id, text).

    The order is cut into blocks at ids that a hash picks (most_blocks of them at most, on average: the only
    thing the driver gets). Texts go to their block compressed; the first text of a block goes to the block
    before as well, and the first of all to the last block. Each task streams its blocks in order and holds
    two texts at a time, so neither long blocks nor repeated ids need memory.
    """
    spark = documents.sparkSession
    ids = documents.select("doc_id")
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.count("doc_id").alias("known")).first()
    every = max(rows_per_block, size["n"] // most_blocks)
    starts = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).distinct().collect() if r[0] is not None)
    first = None if size["known"] < size["n"] else size["first"]
    if starts and starts[0] == first:
        del starts[0]  # the first block begins with the first text
    heads = {s: i for i, s in enumerate(starts)}  # starts[i] is the head of block i + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        schema = pa.schema([("block", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = pack((t or "").encode("utf-8"))
                rows.append((0 if doc_id is None else bisect_right(starts, doc_id), False, doc_id, body))
                if doc_id in heads:
                    rows.append((heads[doc_id], True, doc_id, body))
                if doc_id == first:
                    rows.append((len(starts), True, doc_id, body))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)

    schema = arrow_schema(spark, RESULT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        block = last = None
        for batch in batches:
            rows = []
            for b, guest, doc_id, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, last = b, None
                if guest and last is None:
                    continue  # another row of the same guest came before
                text, known = unpack(body).decode("utf-8"), {}
                own = fingerprint(text, known)
                if last is not None:
                    rows.append(compared(*last, text, own))
                last = None if guest else (doc_id, text, own, known)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    bounded_batches(spark)
    sent = documents.select("doc_id", "text").mapInArrow(send, "block int, guest boolean, doc_id long, body binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return sent.repartition(parts, "block").sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_first(), "body").mapInArrow(compare, RESULT)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of documents and of its edited text, and their likeness."""
    return with_next(table(spark, sf_dir, "documents"))

"""Best-fit packing of token sequences, improved by swap-based local search.

Every text becomes its token ids and a closing id; only longer ones than the capacity are cut. The pieces are
dealt by a hash of their place to blocks of a few thousand, and each block is packed on its own: best fit, largest first, then
local search over the underfull bins. The search takes the emptiest bin and moves a document to where it fits
best, or exchanges it for one smaller document of another bin, or for two, whenever that raises the sum of
squared fills: so the emptiest bins get emptier until they are empty and go. It ends at the lower bound
(total length over capacity, rounded up), or when no exchange helps.
What a block loses against packing all at once is less than a bin.

Defined results: a null or empty text is the closing id alone. Repeated rows are packed each. A block is
bounded by its expected number of pieces whatever the corpus' size; no group depends on a column's values.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import byte_names, vocabulary
from millrace.llm.common import bounded_batches, cut, held, map_rows, table

CAPACITY, CLOSING = 4096, 1
PIECES_IN_BLOCK = 4096
KEPT_CHUNKS = 600_000

#: Texts of these characters are split here as the tokenizer splits them; all others go to the library whole.
PLAIN = re.compile(r"[^\t\n\r -~\xa0-įĲ-ſ‐-‧€]")
_L, _N, _S = "a-zªµºßà-öø-ſ", "0-9²³¹¼½¾", "\\t\\n\\r \\xa0"
SPLIT = re.compile(rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+")


class Encoder:
    """Ids of texts by the tokenizers library as bytes (little-endian, 32 bits each).

    The tokenizer of this vocabulary lower-cases, drops white space, splits what is between into words and encodes each
    alone. So what stands between white space (a chunk) has the same ids wherever it stands: new chunks are split into
    words here, the library's model encodes the new ones of these, and a chunk's ids are kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer.from_file(path)
        self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.names = {b: c for c, b in byte_names().items()} | {32: " "}
        self.chunks: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        """The ids of one text by the whole tokenizer."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words: the model gets them in lines, and ids that end words part them."""
        out = []
        for low in range(0, len(words), 256):
            part = words[low : low + 256]
            line = " ".join(part)
            if not line.isascii():
                line = line.encode("utf-8").decode("latin-1").translate(self.names)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            data = ids.tobytes()
            # should ids not tell where a word ends, the library gets each word
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(part) else map(self._library, part)
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Keeps the ids of new chunks, and of the words in them that are new."""
        known = self.chunks
        split = {c: SPLIT.findall(c) for c in chunks if not c.isalpha()}
        new = {c: None for c in chunks if c not in split}
        new.update((w, None) for words in split.values() for w in words if w not in known)
        known.update(zip(new, self._words(list(new)), strict=True))
        for c, words in split.items():
            if len(words) > 1:
                known[c] = b"".join(map(known.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        get, out = self.chunks.get, []
        new: dict[str, None] = {}
        gaps: list[tuple[int, list, list[tuple[int, str]]]] = []
        for t in texts:
            t = t or ""
            if PLAIN.search(t) or ("<" in t and any(s in t for s in self.special)):
                out.append(self._library(t))
                continue
            chunks = t.lower().split()
            found = list(map(get, chunks))
            if None in found:
                missing = [(i, chunks[i]) for i, x in enumerate(found) if x is None]
                new.update(dict.fromkeys([c for _, c in missing]))
                gaps.append((len(out), found, missing))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if new:
            self._learn(list(new))
            for at, found, missing in gaps:
                for i, c in missing:
                    found[i] = self.chunks[c]
                out[at] = b"".join(found)
            for c in [c for c in new if len(c) > 64]:
                del self.chunks[c]
        return out


def encoder(path: str) -> Encoder:
    """One encoder in each Python process, so what it knows serves all of the process' tasks."""
    return held(path, lambda: Encoder(path))


def pieces(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece."""
    kind = dict(documents.select(F.col(f"`{key}`")).dtypes)[key]
    closing = CLOSING.to_bytes(4, "little")

    def make():
        encode = encoder(path).encode

        def work(batch: dict) -> dict:
            out: dict = {key: [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for k, ids in zip(batch[key], encode(batch[text]), strict=True):
                ids += closing
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in zip(out, (k, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            return out

        return work

    return map_rows(documents, [key, text], f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long", make, keep=path)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: largest first, each into the fullest bin with room."""
    room: dict[int, list[int]] = {}  # free space -> bins
    spaces = 0  # bit r is set if some bin has r free
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = spaces >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                spaces &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if r > n:
            room.setdefault(r - n, []).append(b)
            spaces |= 1 << (r - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Fewer bins, if exchanges between underfull bins can empty some; no bin gets over capacity.

    Every exchange raises the sum of squared fills, so the search ends. A bin that found none is asked again after
    others changed, against those alone.
    """
    search = _Search(bins, lengths, capacity)
    fills, order, inside = search.fills, search.order, search.inside
    least, left = math.ceil(sum(fills.tolist()) / capacity), sum(map(bool, bins))
    waiting, stuck, changed = [(-f, b) for f, b in reversed(order)], set(), False
    clock, tested = 0, [-1] * len(bins)
    while left > least and len(order) > 1:
        if not waiting:
            if not changed:
                break
            waiting, stuck, changed = [(-f, b) for f, b in reversed(order)], set(), False
            heapify(waiting)
            continue
        fill, source = heappop(waiting)
        if fill != fills[source] or source in stuck or not inside[source]:
            continue
        found = search.exchange(source, tested[source] if search.stamp[source] <= tested[source] else -1)
        if found is None:
            stuck.add(source)
            tested[source] = clock
            continue
        clock, changed = clock + 1, True
        for b in search.apply(source, *found, clock):
            if b not in stuck and inside[b] and fills[b] < capacity:
                heappush(waiting, (int(fills[b]), b))
        if not inside[source]:
            left -= 1
    return [b for b in inside if b]


class _Search:
    """The bins during a local search, as arrays over documents and over bins."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int) -> None:
        self.size, self.capacity = np.array(lengths, dtype=np.int64), capacity
        self.inside = [list(b) for b in bins]
        self.of = np.zeros(len(lengths), dtype=np.int64)
        for b, held in enumerate(bins):
            self.of[held] = b
        self.fills = np.bincount(self.of, weights=self.size, minlength=len(bins)).astype(np.int64) if bins else np.zeros(0, dtype=np.int64)
        self.stamp = np.zeros(len(bins), dtype=np.int64)
        self.order = sorted((-int(f), b) for b, f in enumerate(self.fills) if bins[b] and f < capacity)  # underfull bins, the fullest first

    def apply(self, source: int, target: int, out: list[int], back: list[int], clock: int) -> tuple[int, int]:
        d = int(self.size[out].sum() - self.size[back].sum())
        for b, gone, come, by in ((source, out, back, -d), (target, back, out, d)):
            del self.order[bisect_left(self.order, (-int(self.fills[b]), b))]
            self.inside[b] = [i for i in self.inside[b] if i not in gone] + come
            self.of[come] = b
            self.fills[b] += by
            self.stamp[b] = clock
            if self.inside[b] and self.fills[b] < self.capacity:
                insort(self.order, (-int(self.fills[b]), b))
        return source, target

    def exchange(self, source: int, since: int) -> tuple[int, list[int], list[int]] | None:
        """The target, what it gets and what it gives of an exchange that takes length out of the source and raises the sum of squared
        fills: a move, one for one, two for one or one for two. Targets that have not changed since are left out."""
        own: dict[int, list[int]] = {}  # length -> the source's document, or two, of that length
        fill, order, capacity = int(self.fills[source]), self.order, self.capacity
        for i in self.inside[source]:
            own.setdefault(int(self.size[i]), [i])
        singles = sorted(own, reverse=True)
        for n in singles:  # a move to where it fits best: the fullest target with room
            for at in range(bisect_left(order, (n - capacity, -1)), len(order)):
                f, t = order[at]
                if t != source:
                    if n - f > fill:
                        return t, own[n], []
                    break  # those after it are emptier
        open_ = (self.fills < capacity) & (self.stamp > since)
        open_[source] = False
        items = np.flatnonzero(open_[self.of])
        if not len(items):
            return None
        held, fills = self.size[items], self.fills[self.of[items]]
        # a length n may come for a held one if low < n <= high: less comes back, it fits, and the sum rises
        low, high = held + np.maximum(0, fill - fills), held + capacity - fills
        some = low < high
        if some.any():
            steps = np.bincount(low[some] + 1, minlength=capacity + 2) - np.bincount(np.minimum(high[some], capacity) + 1, minlength=capacity + 2)[: capacity + 2]
            covered = np.cumsum(steps) > 0
            ask = [n for n in singles if covered[n]]
            if not ask:
                sums: dict[int, list[int]] = {}
                for x, i in enumerate(self.inside[source]):
                    for j in self.inside[source][:x]:
                        sums.setdefault(int(self.size[i] + self.size[j]), [i, j])
                ask = [n for n in sums if covered[n]]
                own |= {n: sums[n] for n in ask}
            best = (0, 0, 0)
            for n in sorted(ask, reverse=True)[:8]:
                fits = np.flatnonzero((low < n) & (n <= high))
                d = n - held[fits]
                gain = d * (fills[fits] - fill + d)
                at = int(gain.argmax())
                best = max(best, (int(gain[at]), n, int(items[fits[at]])))
            if best[0]:
                return int(self.of[best[2]]), own[best[1]], [best[2]]
        # one for two of a target: for each held document the smallest other one with which the longer document fits
        along = np.lexsort((held, self.of[items]))
        items, held, fills = items[along], held[along], fills[along]
        bins, end = self.of[items], np.arange(1, len(items) + 1)
        keys, spare, more = bins * (capacity + 1) + held, capacity - fills, np.maximum(0, fill - fills)
        for n in singles:
            other = np.maximum(end, np.searchsorted(keys, bins * (capacity + 1) + np.clip(n - spare - held, 0, capacity)))
            last = np.minimum(other, len(items) - 1)
            d = n - held - held[last]
            fits = np.flatnonzero((other < len(items)) & (bins[last] == bins) & (d > more))
            if len(fits):
                at = fits[int((d[fits] * (fills[fits] - fill + d[fits])).argmax())]
                return int(bins[at]), own[n], [int(items[at]), int(items[last[at]])]
        return None


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices for one block."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack_pieces(found: DataFrame, blocks: int, capacity: int = CAPACITY) -> DataFrame:
    """The columns of pieces() with sequence_id and offset. `found` is a written table: its rows are dealt to blocks by
    their place in it, so no value of a column, however often it repeats, makes a block large."""
    kinds = found.dtypes
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds) + ", sequence_id long, offset long"

    def place(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dealt_place", ignore_index=True).drop(columns=["dealt_block", "dealt_place"])
        lengths = rows["length"].tolist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, bin_ in enumerate(pack(lengths, capacity)):
            at = 0
            for i in bin_:
                sequence[i], offset[i] = (int(group[0]) << 32) + number, at
                at += lengths[i]
        return rows.assign(sequence_id=sequence, offset=offset)

    block = F.pmod(F.xxhash64("dealt_place"), F.lit(blocks)).cast("long")
    return found.withColumn("dealt_place", F.monotonically_increasing_id()).withColumn("dealt_block", block).groupBy("dealt_block").applyInPandas(place, schema)


def pack_documents(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, in_block: int = PIECES_IN_BLOCK) -> DataFrame:
    """Every document's pieces with their sequence and place in it. Texts are encoded once: their pieces, some 40 bytes each, are written."""
    bounded_batches(documents.sparkSession)
    found = cut(pieces(documents, path, key, text, capacity), "pieces")
    return pack_pieces(found, max(1, math.ceil(found.count() / in_block)), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))

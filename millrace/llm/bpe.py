"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens: it accepts exactly the token sequences that the merges produce. It starts
as one state with a loop for every byte and is rebuilt merge by merge. The gadget of a merge (u, v):
wherever u and then v can be read, an arc for uv is added that leads where v led; and the state after
u is replaced, for arcs labelled u, by a copy that lacks the arc v - after u alone, v can't follow, as
the two would have been merged. All arcs with one label lead to one state, so a merge adds one state at
most. While it is built, copies share their arcs with the state they were copied from: only the token that a copy
lacks and the merge that made it are stored. Then it is compiled into a table of one bit for a state and a label: states
with the same arcs are one row, labels that the same states lack one column (14,410 by 10,481 for 50,000 merges, 19 MB).
The driver compiles it, and workers get the table.

Every byte string has one accepted token sequence, so each position of a word can be reached in one way
only: encoding follows the transitions, long labels first, and never tries a position twice. Words are split before as the tokenizer
splits them. Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, table

#: Characters on whose splitting all versions of Unicode agree; texts of others are split by the tokenizers library.
PLAIN = re.compile(r"[^\t\n\r -~\xa0-ɏ‐-‧€]")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t\\n\\r \\xa0"
#: The tokenizer's splitting pattern over those characters.
PLAIN_SPLIT = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Words kept with their ids by one worker; beyond, the table is emptied.
KEPT_WORDS = 600_000
ONE = (1,)


@functools.cache
def byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file, to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return names | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Table:
    """The compiled automaton: of a state (the one after a token) and a label, whether there is no arc."""

    live: bytes  # of each token, whether any text has it
    row: list[int]  # of each token, where the row of the state after it begins
    column: list[int]  # of each token, its bit in a row
    lacks: bytes


class TokenAutomaton:
    """States and transitions of a byte-level BPE, built from its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], table: Table | None = None) -> None:
        names = byte_names()
        self.ids = {bytes(names[c] for c in word): i for word, i in vocab.items()}
        self.label = {i: w for w, i in self.ids.items()}
        if table is None:
            table = self._compiled([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.table = table
        # the lengths of the tokens that begin with a pair of bytes, longest first
        lengths: dict[bytes, set[int]] = {}
        for word, i in self.ids.items():
            if len(word) > 1 and table.live[i]:
                lengths.setdefault(word[:2], {1}).add(len(word))
        self.starts = {pair: tuple(sorted(sizes, reverse=True)) for pair, sizes in lengths.items()}

    def has(self, after: int, token: int) -> bool:
        """Whether the state that the automaton is in after a token has an arc for another."""
        t = self.table
        return bool(t.live[token]) and not t.lacks[t.row[after] + (t.column[token] >> 3)] >> (t.column[token] & 7) & 1

    def _compiled(self, merges: list[tuple[int, int, int]]) -> Table:
        size = max(self.label) + 1
        # For each token, the states after it: it begins with the state after its right part, as that was when
        # the token was made, and has one copy more for each merge it stands left in: {lacking token: merge}.
        self.copies: list[dict[int, int]] = [{} for _ in range(size)]
        self.made, self.left, self.right, self.live = [-1] * size, [-1] * size, [-1] * size, [True] * size
        for n, (u, v, uv) in enumerate(merges):
            self._gadget(n, u, v, uv)
        live = bytes(self.live)
        lacks = self._lacking(size)
        # rows and columns that are alike are kept once
        alike: dict[bytes, int] = {}
        row = np.array([alike.setdefault(r.tobytes(), len(alike)) for r in lacks], dtype=np.int64)
        del lacks
        rows = np.frombuffer(b"".join(alike), dtype=np.uint8).reshape(len(alike), -1)
        digest, turn = np.zeros((2, size), dtype=np.uint64), np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], dtype=np.uint64)
        for low in range(0, len(rows), 64):  # 64 bits of each column at a time
            part = np.zeros((64, rows.shape[1]), dtype=np.uint8)
            part[: len(rows[low : low + 64])] = rows[low : low + 64]
            words = np.packbits(np.unpackbits(part, axis=1, count=size, bitorder="little"), axis=0, bitorder="little").T.copy().view(np.uint64)[:, 0]
            digest = (digest ^ words) * turn
            digest ^= digest >> np.uint64(31)
        _, first, column = np.unique(digest, axis=1, return_index=True, return_inverse=True)
        kept = [np.packbits(np.unpackbits(r, count=size, bitorder="little")[first], bitorder="little") for r in rows]
        stride = len(kept[0]) if kept else 0
        return Table(live, (row * stride).tolist(), column.reshape(-1).tolist(), b"".join(k.tobytes() for k in kept))

    def _gadget(self, n: int, u: int, v: int, uv: int) -> None:
        self.live[uv] = self.live[u] and self._has(u, v, n - 1)
        self.made[uv], self.left[uv], self.right[uv] = n, u, v
        self.copies[u].setdefault(v, n)

    def _has(self, after: int, token: int, time: int) -> bool:
        """Whether the state after one token has an arc for another, in the automaton as it was right after the merge `time`."""
        copies, made, right = self.copies, self.made, self.right
        while True:
            owner, until = after, time
            while owner >= 0:  # the state's copies, then what it was first copied from, and so on
                if copies[owner].get(token, until + 1) <= until:
                    return False
                until = min(until, made[owner] - 1)
                owner = right[owner]
            if made[token] < 0:
                return True
            if not self.live[token]:
                return False
            time = min(time, made[token])  # an arc for a pair is where one for its left part was
            token = self.left[token]

    def _lacking(self, size: int) -> np.ndarray:
        """What _has() denies at the end, for all states (rows) and labels (bits): each merge (u, v) takes the labels that begin with v
        from the states that end with u, if it came before what they are part of was made."""
        begin: dict[int, list[tuple[int, int]]] = {}  # token -> the labels that begin with it, and until when it is seen
        end: dict[int, list[tuple[int, int]]] = {}
        last = len(self.made) + 1
        for t in self.label:
            part, until = t, last
            while part >= 0:
                begin.setdefault(part, []).append((-until, t))
                until, part = min(until, self.made[part]), self.left[part]
            part, until = t, last
            while part >= 0:
                end.setdefault(part, []).append((until, t))
                until, part = min(until, self.made[part] - 1), self.right[part]
        labels = {v: (np.array([x for x, _ in sorted(seen)]), np.array([t for _, t in sorted(seen)])) for v, seen in begin.items()}
        out = np.zeros((size, (size + 7) // 8), dtype=np.uint8)
        for u, states in end.items():
            merges = sorted((n, v) for v, n in self.copies[u].items())
            if not merges:
                continue
            taken, packed, at = np.zeros(size, dtype=bool), None, 0
            for until, state in sorted(states):
                began = at
                while at < len(merges) and merges[at][0] <= until:
                    n, v = merges[at]
                    times, which = labels[v]
                    taken[which[: np.searchsorted(times, -n, side="right")]] = True
                    at += 1
                if at > began:
                    packed = np.packbits(taken, bitorder="little")
                if packed is not None:
                    out[state] |= packed
        return out

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word."""
        whole = self.ids.get(word)
        t = self.table
        if whole is not None and t.live[whole]:
            return [whole]
        n, ids, starts = len(word), self.ids, self.starts
        live, row, column, lacks = t.live, t.row, t.column, t.lacks
        out: list[int] = []
        options = [iter(starts.get(word[:2], ONE))]
        dead: set[int] = set()
        at, last = 0, -1
        while at < n:
            for size in options[-1]:
                token = ids.get(word[at : at + size], -1) if at + size <= n else -1
                if token < 0 or at + size in dead:
                    continue
                if live[token] and (last < 0 or not lacks[row[last] + (column[token] >> 3)] >> (column[token] & 7) & 1):
                    at += size
                    last = token
                    out.append(token)
                    options.append(iter(starts.get(word[at : at + 2], ONE)))
                    break
            else:  # no way on: the one path to this position is not the word's
                dead.add(at)
                options.pop()
                at -= len(self.label[out.pop()])
                last = out[-1] if out else -1
        return out


class BpeCodec:
    """encode() and decode() of a tokenizer file of the kind ByteLevel BPE without normalizer."""

    def __init__(self, path: str, table: Table | None = None) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = TokenAutomaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], table)
        self.bytes_of = self.automaton.label | {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.splitter = None

    def split(self, text: str) -> list[str]:
        """The words of a text, as the tokenizers library splits it."""
        if PLAIN.search(text) is None:
            return PLAIN_SPLIT.findall(text)
        if self.splitter is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each word of a text without special tokens."""
        words, split = self.words, self.split(text)
        if len(words) > KEPT_WORDS:
            words.clear()
        found = list(map(words.get, split))
        if None in found:
            encode = self.automaton.encode
            for i, word in enumerate(split):
                if found[i] is None:
                    if (ids := words.get(word)) is None:
                        ids = tuple(encode(word.encode("utf-8")))
                        if len(word) <= 64:
                            words[word] = ids
                    found[i] = ids
        return found

    def _words(self, text: str | None) -> list[tuple[int, ...]]:
        """The ids of each word and special token."""
        text = text or ""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._plain(text[at : m.start()]), (self.special[m[0]],)]
            at = m.end()
        return out + self._plain(text[at:])

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self._words(text)))

    def count(self, text: str | None) -> int:
        """How many ids encode() would give."""
        return sum(map(len, self._words(text)))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str, table: Broadcast | None = None) -> BpeCodec:
    """One codec for a file in each Python process. Without a table it compiles one, which takes some seconds and 400 MB for a while."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path, table.value if table else None)
    return _CODECS[path]


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The compiled table for workers: its size is the vocabulary's, whatever the corpus'."""
    return spark.sparkContext.broadcast(codec(path).automaton.table)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>: the token ids of every text (null or empty: none)."""
    kind = dict(documents.select(F.col(f"`{key}`")).dtypes)[key]

    table_ = shipped(documents.sparkSession, path)

    def make():
        c = codec(path, table_)
        return lambda batch: {key: batch[key], "ids": [c.encode(t) for t in batch[text]]}

    return map_rows(documents, [key, text], f"`{key}` {kind}, ids array<int>", make)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: what the ids stand for (null ids: empty)."""
    kind = dict(encoded.select(F.col(f"`{key}`")).dtypes)[key]

    table_ = shipped(encoded.sparkSession, path)

    def make():
        c = codec(path, table_)
        return lambda batch: {key: batch[key], "text": [c.decode(x or []) for x in batch[ids]]}

    return map_rows(encoded, [key, ids], f"`{key}` {kind}, text string", make)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every text of documents, and digest of the decoded text.

    Null and empty texts have no ids and decode to the empty text.
    """
    path = vocabulary("byte_bpe_50k.json")

    table_ = shipped(spark, path)

    def make():
        c = codec(path, table_)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        decimal = {i: str(i) for i in c.bytes_of}

        def work(batch: dict) -> dict:
            out: dict = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in batch["text"]:
                ids = c.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(",".join(map(decimal.__getitem__, ids)).encode()))
                out["decoded_sha256"].append(sha(c.decode(ids).encode("utf-8")))
            return out

        return work

    documents = table(spark, sf_dir, "documents")
    return map_rows(documents, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)

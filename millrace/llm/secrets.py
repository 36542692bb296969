"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

`base_spans` finds what fixed patterns find. `MarkovScorer` scores what these leave of every long run of key
characters, and its pieces, by the log-likelihood ratio of two order-2 character models: one of random strings, one
of ordinary identifiers. Both are trained here from labelled samples: random strings drawn with a
fixed seed from the alphabets of keys (base64, base62, hex), identifiers from the names in Python's
own standard library, alone and joined, and - in `train` - a bounded sample of the corpus, where
words without digits are labelled ordinary and values under the base patterns random.

Defined results: a null or empty text has no spans; repeated rows give repeated results; texts of
any length are scanned whole (one pass of C-level byte searches, memory in proportion to the text);
an empty table gives an empty result and the models are then trained from the built-in samples alone.
"""

from __future__ import annotations

import hashlib
import importlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, smallest, sum_rows, table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PIECE = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Za-z][A-Za-z_-]{3,}")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RUN = 6, 20, 24, 20
#: So many words and values, of so many characters of text, are counted before their triples are.
HELD_WORDS, HELD_CHARS = 200_000, 64 << 20
#: A corpus weighs as much as so many of its documents do, however many it has: else what the built-in samples teach would be lost in a large one.
WEIGHT_DOCS = 2000
#: Where their number stands among the counts of triples.
DOCUMENTS = (True, "")

#: One byte for each code point: whether it belongs to a run.
_HEX_BYTES = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_RUN_BYTES = bytes(104 if i < 128 and (chr(i).isalnum() or chr(i) in "+/_=-") else 32 for i in range(256))
_LOWER_BYTES = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

Span = tuple[int, int, str]


def _runs(classes: bytes, least: int) -> Iterable[tuple[int, int]]:
    """Maximal runs of at least so many characters, from a text's bytes of class."""
    needle, at = b"h" * least, 0
    while (start := classes.find(needle, at)) >= 0:
        at = classes.find(b" ", start)
        at = len(classes) if at < 0 else at
        yield start, at


def base_spans(text: str, points: bytes | None = None) -> list[Span]:
    """(start, end, kind) of the base patterns, in code points, leftmost and non-overlapping per kind."""
    points = text.encode("latin-1", "replace") if points is None else points
    found: list[Span] = []
    low = points.translate(_LOWER_BYTES)
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if b"AKIA" in points:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(a, b, "hex") for a, b in _runs(points.translate(_HEX_BYTES), MIN_HEX)]
    return found


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def random_samples(n: int = 4000, seed: int = 7) -> list[str]:
    """Labelled sample: random strings over the alphabets of keys."""
    draw = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (lower + upper + digits + "+/", lower + upper + digits, lower + upper + digits + "_-", digits + "abcdef", upper + digits)
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(MIN_RUN, 64))) for i in range(n)]


def ordinary_samples(n: int = 8000, seed: int = 8) -> list[str]:
    """Labelled sample: identifiers of the standard library, alone and joined as paths, slugs and dates are."""
    names: list[str] = []
    for module in ("builtins", "os", "socket", "string", "ssl", "datetime", "logging", "email", "http.client", "unittest", "ast", "subprocess", "argparse", "inspect", "tarfile", "zipfile", "threading", "typing", "collections", "urllib.parse"):
        held = importlib.import_module(module)  # without its submodules, of which it shows those that were imported
        names += [x for x in dir(held) if not x.startswith("__") and not isinstance(getattr(held, x), ModuleType)]
    names, draw = sorted(set(names)), random.Random(seed)
    numbers = lambda: draw.choice(["", "1", "2", "10", "2019", "2024", "01"])
    return [draw.choice("_-/=+").join(draw.choice(names) + numbers() for _ in range(draw.randint(1, 4))) for _ in range(n)] + names


class MarkovScorer:
    """Two order-2 character models and a threshold on their log-likelihood ratio."""

    ALPHABET = 66  # 64 characters of keys, `=` and the edge

    def __init__(self, random_counts: Counter, ordinary_counts: Counter, per_char: float, total: float) -> None:
        self.per_char, self.total = per_char, total
        self.ratio: dict[str, float] = {}
        sides = []
        for counts in (random_counts, ordinary_counts):
            context: Counter = Counter()
            pair: Counter = Counter()
            middle: Counter = Counter()
            for gram, n in counts.items():
                context[gram[:2]] += n
                pair[gram[1:]] += n
                middle[gram[1]] += n
            sides.append((counts, context, pair, middle))
        self.sides = sides

    @staticmethod
    def grams(text: str) -> Iterable[str]:
        padded = f"^^{text}"
        return map("".join, zip(padded, padded[1:], padded[2:], strict=False))

    @classmethod
    def count(cls, texts: Iterable[str]) -> Counter:
        counts: Counter = Counter()
        for t in texts:
            counts.update(cls.grams(t))
        return counts

    def _log(self, gram: str, side: int) -> float:
        """Log probability of the third character after the first two, backed off to one and none."""
        counts, context, pair, middle = self.sides[side]
        low = 1 / self.ALPHABET
        one = (pair[gram[1:]] + 8 * low) / (middle[gram[1]] + 8)
        return math.log((counts[gram] + 8 * one) / (context[gram[:2]] + 8))

    def score(self, text: str) -> float:
        """log P(text | random) - log P(text | ordinary)."""
        total = 0.0
        for gram in self.grams(text):
            value = self.ratio.get(gram)
            if value is None:
                value = self.ratio[gram] = self._log(gram, 0) - self._log(gram, 1)
            total += value
        return total

    def is_secret(self, text: str) -> bool:
        score = self.score(text)
        return score >= self.total and score >= self.per_char * len(text)

    def spans(self, text: str, points: bytes, taken: list[Span]) -> list[Span]:
        """What looks random of the runs of key characters, without what the spans found before take of them: each part that is
        left as a whole, or else the pieces between its `+/_=-`, so that a key is found that a long path is joined to."""
        found = []
        for a, b in outside(_runs(points.translate(_RUN_BYTES), MIN_RUN), taken):
            if b - a < MIN_RUN:
                continue
            if self.is_secret(text[a:b].strip("=-_/+")):
                found.append((a, b, "markov"))
            else:
                found += [(a + m.start(), a + m.end(), "markov") for m in PIECE.finditer(text[a:b]) if m.end() - m.start() >= MIN_RUN and self.is_secret(m[0])]
        return found


def outside(runs: Iterable[tuple[int, int]], taken: list[Span]) -> Iterable[tuple[int, int]]:
    """The parts of the runs (in order) that no span takes; one pass over both."""
    spans, at = sorted((a, b) for a, b, _ in taken), 0
    for a, b in runs:
        while at < len(spans) and spans[at][0] < b:
            low, high = spans[at]
            if high <= a:
                at += 1
                continue
            if low > a:
                yield a, low
            a = max(a, high)
            if high > b:
                break  # it may take of the next run, too
            at += 1
        if a < b:
            yield a, b


def calibrated(random_counts: Counter, ordinary_counts: Counter) -> MarkovScorer:
    """A scorer whose threshold a fresh labelled sample sets: no ordinary string of it passes."""
    scorer = MarkovScorer(random_counts, ordinary_counts, 0.0, 0.0)
    ordinary = [x for x in ordinary_samples(4000, seed=80) if len(x) >= MIN_RUN]
    worst = max(scorer.score(x) / len(x) for x in ordinary)
    scorer.per_char, scorer.total = max(0.25, worst + 0.05), 12.0
    return scorer


def built_in() -> MarkovScorer:
    return calibrated(MarkovScorer.count(random_samples()), MarkovScorer.count(ordinary_samples()))


def train(documents: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int | None = 2000) -> MarkovScorer:
    """Models from the built-in samples and from at most `sample_docs` documents (those with the smallest hashes
    of `key`), or from all if that is None; only counts of character triples come to the driver. Over WEIGHT_DOCS
    documents every one counts for less, by the same factor."""
    rows = documents if sample_docs is None else smallest(documents, key, sample_docs)
    if rows is None:
        return built_in()
    counts = sum_rows(rows, [text], "ordinary boolean, gram string, n long", lambda: _counted(text))
    sums: tuple[Counter, Counter] = (MarkovScorer.count(random_samples()), MarkovScorer.count(ordinary_samples()))
    found = {(row["ordinary"], row["gram"]): row["n"] for row in counts.groupBy("ordinary", "gram").agg(F.sum("n").alias("n")).collect()}
    weight = min(1.0, WEIGHT_DOCS / max(1, found.pop(DOCUMENTS, 0)))
    for (ordinary, gram), n in sorted(found.items()):
        sums[ordinary][gram] += n * weight
    return calibrated(*sums)


def _counted(text: str):
    values, words, documents, read = Counter(), Counter(), 0, 0

    def add(batch: dict) -> bool:
        nonlocal documents, read
        documents += len(batch[text])
        for t in filter(None, batch[text]):
            spans = base_spans(t)
            values.update(t[a:b].rpartition("=")[2].rpartition(":")[2].strip(" \"'") for a, b, _ in spans)
            words.update(_words_beside(t, spans) if spans else WORD.findall(t))
            read += len(t)
        return len(values) + len(words) > HELD_WORDS or read > HELD_CHARS

    def rest() -> dict:
        nonlocal documents, read
        rows = [(*DOCUMENTS, documents)]
        for ordinary, some in ((False, values), (True, words)):
            sums: Counter = Counter()
            for w, n in some.items():
                for gram in MarkovScorer.grams(w):
                    sums[gram] += n
            rows += [(ordinary, gram, n) for gram, n in sums.items()]
            some.clear()
        documents = read = 0
        return {name: [r[i] for r in rows] for i, name in enumerate(("ordinary", "gram", "n"))}

    return add, rest


def _words_beside(text: str, spans: list[Span]) -> Iterable[str]:
    """The words that no span touches; one pass over both."""
    taken, at = sorted((a, b) for a, b, _ in spans), 0
    reach = list(accumulate((b for _, b in taken), max))  # spans of different kinds may overlap
    for m in WORD.finditer(text):
        while at < len(taken) and reach[at] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            yield m[0]


def find_secrets(text: str | None, scorer: MarkovScorer) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each in order."""
    text = text or ""
    points = text.encode("latin-1", "replace")
    base = base_spans(text, points)
    return in_order(base), in_order(base + scorer.spans(text, points, base))


def redacted(text: str | None, spans: list[Span], mark: str = "[secret]") -> str | None:
    """The text with every span replaced; overlapping spans are replaced as one."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame, scorer: MarkovScorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base array<struct>, spans array<struct>, clean text with the spans redacted."""
    kind = dict(documents.select(F.col(f"`{key}`")).dtypes)[key]

    def make():
        def work(batch: dict) -> dict:
            found = [find_secrets(t, scorer) for t in batch[text]]
            as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
            return {key: batch[key], "base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found], "clean": [redacted(t, s) for t, (_, s) in zip(batch[text], found, strict=True)]}

        return work

    span = "array<struct<start:bigint,end:bigint,kind:string>>"
    return map_rows(documents, [key, text], f"`{key}` {kind}, base {span}, spans {span}, clean string", make)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text of documents, as counts, a digest of the base spans, and all spans."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = train(documents)

    def make():
        def work(batch: dict) -> dict:
            out: dict = {"doc_id": batch["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for t in batch["text"]:
                base, spans = find_secrets(t, scorer)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return out

        return work

    return map_rows(documents, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)

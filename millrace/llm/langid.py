"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a
word is the sum, over all ways to cut it into pieces, of the product of their probabilities; a forward
pass over the word's positions computes it without listing the ways. A text's score for a language is
the sum of the logarithms over its words, plus the language's prior; a softmax over languages gives
the score of the answer.

The piece probabilities come from the training rows: how often each piece occurs in their words,
smoothed. They are counted in the executors, over all of them or a bounded sample (`sample_docs`, those with
the smallest hashes); the driver gets one count for a language and piece, 32,000 pieces at most.

Defined results: null text and text without letters: `und` with score 0. Repeated rows give repeated
results; texts are scored whole, words of over 48 letters in parts. With no training rows everything is `und`.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, map_rows, median, smallest, sum_rows, table

UNDETERMINED = "und"
#: Runs of letters in texts of Latin characters only, and in all others.
LATIN = re.compile(r"[^\x00-ɏ‐-‧€]")
LATIN_WORD, WORD = re.compile("[a-zªµºà-öø-ɏ]+"), re.compile(r"[^\W\d_]+")
LONGEST_WORD, LONGEST_PIECE, RESCALED = 48, 16, 8
KEPT_WORDS = 400_000
#: So many words, of so many characters of text, are counted before their pieces are.
HELD_WORDS, HELD_CHARS = 200_000, 64 << 20


@functools.cache
def vocabulary() -> dict[str, int]:
    """Pieces of the public vocabulary (`▁` begins a word), lower case, without byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i))
    return {p: i for i, p in enumerate(sorted({p.lower() for p in pieces if len(p) <= LONGEST_PIECE}))}


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (WORD if LATIN.search(low) else LATIN_WORD).findall(low)


def parts(word: str) -> list[str]:
    """The word with its mark, in parts of bounded length."""
    marked = f"▁{word}"
    return [marked[i : i + LONGEST_WORD] for i in range(0, len(marked), LONGEST_WORD)]


@functools.cache
def prefixes() -> dict[str, int]:
    """Every prefix of a piece; to the piece's number, or -1 if it is none itself."""
    out = {p[:n]: -1 for p in vocabulary() for n in range(1, len(p))}
    return out | vocabulary()


@functools.cache
def trie() -> dict:
    """The pieces by character: (the piece's number, or -1 if it is only a prefix; what may follow)."""
    def below(upto: int, some: list[str]) -> dict:
        by: dict[str, list[str]] = {}
        for p in some:
            if len(p) > upto:
                by.setdefault(p[upto], []).append(p)
        return {c: (prefixes()[ps[0][: upto + 1]], below(upto + 1, ps)) for c, ps in by.items()}

    return below(0, list(vocabulary()))


class LanguageModel:
    """langs, log priors, and a probability for each piece and language; the last row is for a character unseen."""

    def __init__(self, langs: list[str], prior: list[float], probability: np.ndarray) -> None:
        self.langs, self.prior, self.probability = langs, np.array(prior), probability

    def part_logs(self, texts: list[str]) -> np.ndarray:
        """Log of the sum over all segmentations of each part, by language.

        The forward pass goes over positions, for all parts at once: what reaches position i times a piece's
        probability is added to what reaches its end. Every RESCALED positions what reaches them is set to 1 and its logarithm
        kept, as the product over a part of unseen characters would be 0.
        """
        root, unseen, spans, pieces, sizes = trie(), len(self.probability) - 1, array("q"), array("q"), []
        for part in texts:
            before = len(spans)
            for i in range(len(part)):
                node, j = root, i
                for c in part[i : i + LONGEST_PIECE]:
                    hit = node.get(c)
                    if hit is None:
                        break
                    j += 1
                    p, node = hit
                    if p >= 0:
                        spans.append(i << 6 | j)
                        pieces.append(p)
                    elif j == i + 1:  # any single character can be read
                        spans.append(i << 6 | j)
                        pieces.append(unseen)
                if j == i:
                    spans.append(i << 6 | i + 1)
                    pieces.append(unseen)
            sizes.append(len(spans) - before)
        steps = np.frombuffer(spans, dtype=np.int64) << 33 | np.repeat(np.arange(len(texts)), sizes) << 16 | np.frombuffer(pieces, dtype=np.int64) if spans else np.zeros(0, dtype=np.int64)
        ways = np.zeros((LONGEST_WORD + 1, len(texts), len(self.langs)))
        ways[0] = 1.0
        order = np.sort(steps)
        places = order >> 33
        cuts = np.flatnonzero(np.diff(places, prepend=-1, append=-1))
        lengths, scale, scaled = np.array([len(t) for t in texts], dtype=np.int64), np.zeros((len(texts), len(self.langs))), 0
        for low, high in zip(cuts, cuts[1:], strict=False):
            i, j = int(places[low]) >> 6, int(places[low]) & 63
            if i >= scaled + RESCALED:  # all that reaches i is there; nothing before i is read again
                long = np.flatnonzero(lengths >= i)
                by = np.where(ways[i, long] > 0, ways[i, long], 1.0)
                ways[i : i + LONGEST_PIECE + 1, long] /= by
                scale[long] += np.log(by)
                scaled = i
            w, p = (order[low:high] >> 16) & 0x1FFFF, order[low:high] & 0xFFFF
            ways[j, w] += ways[i, w] * self.probability[p]
        return np.log(ways[lengths, np.arange(len(texts))]) + scale

    def word_logs(self, words: list[str]) -> np.ndarray:
        """The same for words, which may have several parts."""
        cut = [parts(w) for w in words]
        out = np.zeros((len(words), len(self.langs)))
        flat = [(i, p) for i, ps in enumerate(cut) for p in ps]
        for at in range(0, len(flat), 20_000):
            some = flat[at : at + 20_000]
            np.add.at(out, [i for i, _ in some], self.part_logs([p for _, p in some]))
        return out


class Scorer:
    """A model with the words it has scored."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.kept, self.rows = model, {}, np.zeros((1024, len(model.langs) + 1))  # the last column: letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """Language, score, the text's log-likelihood in that language, and its letters."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        split = [words_of(t) if t else [] for t in texts]
        found = [list(map(self.kept.get, words)) for words in split]
        gaps = [(at, [i for i, x in enumerate(at) if x is None], words) for at, words in zip(found, split, strict=True) if None in at]
        new = list(dict.fromkeys(words[i] for _, missing, words in gaps for i in missing))
        if new and self.model.langs:
            at = len(self.kept)
            if (grown := at + len(new)) > len(self.rows):
                self.rows = np.concatenate([self.rows[:at], np.zeros((max(grown, 2 * at) - at, self.rows.shape[1]))])
            self.rows[at:grown, :-1] = self.model.word_logs(new)
            self.rows[at:grown, -1] = list(map(len, new))
            self.kept.update(zip(new, range(at, grown), strict=True))
            for places, missing, words in gaps:
                for i in missing:
                    places[i] = self.kept[words[i]]
        return list(map(self._best, split, found))

    def _best(self, words: list[str], places: list[int]) -> tuple[str, float, float, int]:
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0, 0.0, 0
        sums = self.rows[places].sum(axis=0)
        total = sums[:-1] + self.model.prior
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum()), float(sums[best]), int(sums[-1])


def known(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that have a text and a language."""
    return labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int | None = 4000, smoothing: float = 0.5) -> LanguageModel:
    """A model from at most `sample_docs` rows (those with the smallest hashes of key, one row of a key), or from all if that is None."""
    rows = known(labelled, text, lang)
    if sample_docs is not None:
        rows = smallest(rows, key, sample_docs)
    found = [] if rows is None else sum_rows(rows, [text, lang], "lang string, piece int, n long", lambda: _pieces(text, lang)).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    if not found:
        return LanguageModel([], [], np.zeros((len(vocabulary()) + 1, 0)))
    langs = sorted({r["lang"] for r in found})
    column = {name: i for i, name in enumerate(langs)}
    table_, docs = np.zeros((len(vocabulary()), len(langs))), [0] * len(langs)
    for r in found:
        if r["piece"] < 0:
            docs[column[r["lang"]]] = r["n"]
        else:
            table_[r["piece"], column[r["lang"]]] = r["n"]
    sizes = table_.sum(axis=0) + smoothing * len(table_)
    return LanguageModel(langs, [math.log(d / sum(docs)) for d in docs], np.vstack([(table_ + smoothing) / sizes, smoothing / sizes]))


def _pieces(text: str, lang: str):
    """To sum by language: how often each piece occurs in the words of texts, and the texts as piece -1."""
    piece, held, texts, read = prefixes().get, {}, Counter(), 0  # held: how often a language has each word

    def add(batch: dict) -> bool:
        nonlocal read
        for t, name in zip(batch[text], batch[lang], strict=True):
            held.setdefault(name, Counter()).update(words_of(t))
            texts[name] += 1
            read += len(t)
        return sum(map(len, held.values())) > HELD_WORDS or read > HELD_CHARS

    def rest() -> dict:
        nonlocal read
        sums: dict[str, Counter] = {name: Counter({-1: n}) for name, n in texts.items()}
        for name, words in held.items():
            c = sums[name]
            for w, n in words.items():
                for part in parts(w):
                    for i in range(len(part)):
                        for j in range(i + 1, min(len(part), i + LONGEST_PIECE) + 1):
                            if (p := piece(part[i:j])) is None:
                                break
                            if p >= 0:
                                c[p] += n
        held.clear()
        texts.clear()
        read = 0
        flat = [(name, p, n) for name, c in sums.items() for p, n in c.items()]
        return {"lang": [x[0] for x in flat], "piece": [x[1] for x in flat], "n": [x[2] for x in flat]}

    return add, rest


def predict(documents: DataFrame, model: LanguageModel, columns: list[str], text: str = "text", pred: str = "lang_pred", score: str = "score", evidence: tuple[str, str] | None = None) -> DataFrame:
    """`columns` of documents, and the prediction and its score under names that are not among them.

    evidence: names of two more columns, the text's log-likelihood in the predicted language and its number of letters.
    """
    kinds = dict(documents.select(*[F.col(f"`{c}`") for c in columns]).dtypes)
    wanted, added = list(dict.fromkeys([*columns, text])), [pred, score, *(evidence or ())]

    def make():
        scorer = Scorer(model)

        def work(batch: dict) -> dict:
            found = scorer.predict(batch[text])
            return {c: batch[c] for c in columns} | {c: [x[i] for x in found] for i, c in enumerate(added)}

        return work

    return map_rows(documents, wanted, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + "".join(f", `{c}` {kind}" for c, kind in zip(added, ("string", "double", "double", "long"), strict=False)), make)


@dataclass(frozen=True)
class Typical:
    """What texts of the learned languages are like: log-likelihood for a letter. A text of few letters is drawn to the middle."""

    middle: float
    floor: float
    letters: int = 50

    def fits(self, total: Column, letters: Column) -> Column:
        return (total + self.letters * self.middle) / (letters + self.letters) >= self.floor


def typical(labelled: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang") -> Typical:
    """`typical_of` all labelled rows, which are scored for it; only their evidence is written."""
    found = predict(known(labelled, text, lang).select(F.col(f"`{text}`").alias("text")), model, ["text"], evidence=("total", "letters"))
    return typical_of(cut(found.select("total", "letters"), "evidence"), "total", "letters")


def typical_of(found: DataFrame, total: str, letters: str, spreads: float = 10.0, least: float = 1.5) -> Typical:
    """From the evidence of all labelled rows: the median, and a floor so many (robust) standard deviations and at least `least` below it, so that
    texts that mix the languages or are tables of names stay, while those of other languages and scripts go, as they cost twice as much or more.

    found is read several times: the medians are exact, whatever the number of rows, and no row comes to the driver."""
    rows = found.where(F.col(letters) > 0)
    middle = median(rows, F.col(total) / F.col(letters))
    if middle is None:
        return Typical(0.0, -math.inf)
    drawn = (F.col(total) + Typical.letters * middle) / (F.col(letters) + Typical.letters)
    usual = median(rows, drawn)
    spread = 1.4826 * median(rows, F.abs(drawn - usual))
    return Typical(middle, usual - max(spreads * spread, least))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; fold 0 is held out."""
    return F.crc32(key.cast("string")) % 5


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text of documents; learned from folds 1 to 4 alone."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(fold(F.col("doc_id")) != 0))
    return predict(documents, model, ["doc_id"]).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""A corpus pipeline of four stages over documents: language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. Stages
are written as Parquet to the folder of spark.checkpoint.dir and read again, so a lost executor costs one stage's
tasks, not the stages before. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, minhash, packing, secrets
from millrace.llm.bpe import vocabulary
from millrace.llm.common import cut, map_rows, table

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that docs' own labels teach, all of them: those without letters go, and those that are far less likely in
    their best language than labelled documents are in theirs (`langid.typical_of`), as texts of other languages and scripts."""
    model = langid.train(docs, sample_docs=None)
    found = langid.predict(docs, model, docs.columns, pred="stage_lang_pred", score="stage_lang_score", evidence=("stage_lang_total", "stage_lang_letters"))
    found = cut(found, "evidence")  # texts are scored once, for what is typical and for what is kept
    fits = langid.typical_of(langid.known(found), "stage_lang_total", "stage_lang_letters")
    kept = fits.fits(F.col("stage_lang_total"), F.col("stage_lang_letters"))
    return found.where((F.col("stage_lang_pred") != langid.UNDETERMINED) & kept).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5 words, similarity 0.8): the one with the smallest id. Of rows
    that repeat one stays; rows that share an id but not the text are documents of their own, as are rows without id."""
    return minhash.one_of_each(docs, minhash.NearSettings())


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars to match; others are as they were."""
    scorer = secrets.train(docs, sample_docs=None)
    kinds = dict(docs.dtypes)

    def make():
        def work(batch: dict) -> dict:
            clean = [secrets.redacted(t, secrets.find_secrets(t, scorer)[1]) for t in batch["text"]]
            changed = [len(c) if c != t else n for c, t, n in zip(clean, batch["text"], batch["n_chars"], strict=True)]
            return batch | {"text": clean, "n_chars": changed}

        return work

    return map_rows(docs, docs.columns, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns), make)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Tokenizers, trained models and local search are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

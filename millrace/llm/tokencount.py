"""Token counts: an exact histogram of encoded lengths, and what follows from its suffix sums.

Documents are aggregated by their number of tokens, so the histogram has one row for each length that
occurs, whatever the corpus' size. Suffix sums over it answer for every context limit L that is one of the
lengths: how many documents are at least that long, how many tokens all have together, and how many remain
if each is cut to L tokens. `truncated_total` answers for any other limit, `quantile` for any share.

Sums run in two levels: inside blocks of lengths in parallel, and over the blocks' totals, of which
there is one for 256 lengths. Defined results: null and empty texts have length 0; repeated rows count
each; an empty table has an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import codec, shipped, vocabulary
from millrace.llm.common import cut, map_rows, table

BLOCK = 256


def token_lengths(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """length: the number of tokens of each text."""

    table_ = shipped(documents.sparkSession, path)

    def make():
        count = codec(path, table_).count
        return lambda batch: {"length": list(map(count, batch[text]))}

    return map_rows(documents, [text], "length long", make)


def histogram(lengths: DataFrame) -> DataFrame:
    """length -> docs: one row for each length that occurs. Written, as what is asked of it reads it more than once."""
    return cut(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("docs")), "lengths")


def suffix_sums(counts: DataFrame) -> DataFrame:
    """length, docs, tokens, docs_at_least, tokens_at_least, tokens_cut (all texts cut to `length` tokens)."""
    rows = counts.withColumns({"block": F.floor(F.col("length") / BLOCK), "tokens": F.col("length") * F.col("docs")})
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("block_tokens").over(total).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_least = lambda c: F.sum(c).over(inside) + F.col(f"{c}_after")
    summed = rows.join(blocks, "block").select("length", "docs", "tokens", at_least("docs").alias("docs_at_least"), at_least("tokens").alias("tokens_at_least"), "all_tokens")
    return summed.select(
        "length", "docs", "tokens", "docs_at_least", "tokens_at_least", (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("tokens_cut")
    )


def truncated_total(counts: DataFrame, limit: int | Column) -> DataFrame:
    """One row, tokens: what is left of the corpus if every document is cut to `limit` tokens."""
    return counts.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("docs")), F.lit(0)).alias("tokens"))


def quantile(counts: DataFrame, share: float) -> DataFrame:
    """One row, length: the least length that at least `share` of the documents do not exceed."""
    sums = suffix_sums(counts)
    size = counts.agg(F.sum("docs").alias("all_docs"))
    short = F.col("all_docs") - F.col("docs_at_least") + F.col("docs")
    return sums.join(F.broadcast(size)).where(short >= share * F.col("all_docs")).agg(F.min("length").alias("length"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of the lengths of all texts of documents in tokens, with its suffix sums."""
    return suffix_sums(histogram(token_lengths(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))))

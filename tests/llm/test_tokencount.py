"""Length histogram against counting."""

from tokenizers import Tokenizer

from millrace.llm import tokencount as C
from millrace.llm.bpe import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def check(rows, lengths):
    assert {r["length"]: r["docs"] for r in rows} == {n: lengths.count(n) for n in set(lengths)}
    for r in rows:
        at_least = [n for n in lengths if n >= r["length"]]
        assert (r["docs_at_least"], r["tokens_at_least"], r["tokens_cut"]) == (len(at_least), sum(at_least), sum(min(n, r["length"]) for n in lengths))


def test_query(spark, sf):
    library = Tokenizer.from_file(PATH)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(C.op5_token_counts(spark, sf).collect(), [len(library.encode(t, add_special_tokens=False).ids) for t in texts])


def test_sums_quantiles_and_limits(spark):
    lengths = [0, 0, 1, 5, 5, 5, 4095, 4096, 4097, 100_000, 100_000]
    counts = C.histogram(spark.createDataFrame([(n,) for n in lengths], "length long"))
    check(C.suffix_sums(counts).collect(), lengths)
    for limit in (0, 3, 4096, 10**9):
        assert C.truncated_total(counts, limit).first()[0] == sum(min(n, limit) for n in lengths)
    for share in (0.1, 0.5, 0.9, 1.0):
        want = min(n for n in lengths if sum(m <= n for m in lengths) >= share * len(lengths))
        assert C.quantile(counts, share).first()[0] == want


def test_edges(spark):
    docs = spark.createDataFrame([(None, 1), ("", 2), ("a b", 3), ("a b", 3)], "text string, length int")
    check(C.suffix_sums(C.histogram(C.token_lengths(docs, PATH))).collect(), [0, 0, 2, 2])
    none = C.histogram(C.token_lengths(docs.where("false"), PATH))
    assert C.suffix_sums(none).count() == 0 and C.truncated_total(none, 5).first()[0] == 0

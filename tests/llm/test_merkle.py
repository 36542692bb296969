"""Fingerprints: equality, edits, and the order of documents."""

import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import merkle as M


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n!é", max_size=80), st.text(alphabet="ab. \n!é", max_size=80))
def test_equal_texts_only(a, b):
    assert (M.fingerprint(a) == M.fingerprint(b)) == (a == b)
    assert "".join(M.LEAF.findall(a)) == a
    assert 0 <= M.likeness(M.fingerprint(a), M.fingerprint(b)) <= 1 and M.likeness(M.fingerprint(a), M.fingerprint(a)) == 1


def test_root_follows_from_the_leaves():
    shown = M.fingerprint("One. Two!\nThree\n\nFour. " * 20)
    top, _, rest = shown.partition(":")
    assert top == M.root(rest) and M.fingerprint(None) == M.fingerprint("")


def test_differences_locate_an_edit():
    lines = [f"Line {i} has some words. And some more." for i in range(100)]
    before = M.fingerprint("\n".join(lines))
    lines[40] = "Changed."
    after = M.fingerprint("\n".join(lines))
    where = M.differences(before, after)
    sections = before.partition(":")[2].split(";")
    flat = [(i, j) for i, s in enumerate(sections) for j in range(len(s.split(",")))]
    assert where == [flat[40]] and M.differences(before, before) == []
    assert 0.95 < M.likeness(before, after) < 1


def plain_leaves(text):
    """Leaves by looking at one character after the other."""
    out, i, n = [], 0, len(text)
    while i < n:
        k = i
        while k < n and k - i < 200 and text[k] not in ".!?\n":
            k += 1
        ends = k
        while k < n and text[k] in ".!?":
            k += 1
        if k > ends and text[k : k + 1] == " ":
            k += 1
        if text[k : k + 1] == "\n":
            k += 1
        out.append(text[i:k])
        i = k
    return out


def plain_print(text):
    """The tree of nested lists, hashed from the bottom."""
    h = lambda x, n=6: hashlib.blake2b(x.encode(), digest_size=n).hexdigest()
    sections, paragraph = [[]], []
    for leaf in plain_leaves(text):
        paragraph.append(leaf)
        if leaf.endswith("\n"):
            sections[-1].append(paragraph)
            if paragraph == ["\n"] or int(h("".join(map(h, paragraph)))[:2], 16) % 8 == 0:
                sections.append([])
            paragraph = []
    sections[-1] += [paragraph] if paragraph else []
    sections = [[list(map(h, p)) for p in s] for s in sections if s] or [[[]]]
    tops = [h("".join(h("".join(p)) for p in s)) for s in sections]
    return h("".join(tops), 16), [x for s in sections for p in s for x in p]


def plain_likeness(a, b):
    (ra, x), (rb, y) = plain_print(a), plain_print(b)
    if ra == rb:
        return 1.0
    return 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n!é", max_size=120), st.text(alphabet="ab. \n!é", max_size=120), st.integers(0, 3))
def test_against_a_plain_tree(a, b, times):
    a, b = a * times + b, b + a
    assert plain_leaves(a) == M.LEAF.findall(a)
    assert M.fingerprint(a).partition(":")[0] == plain_print(a)[0] and M.leaves(M.fingerprint(a)) == plain_print(a)[1]
    assert abs(M.likeness(M.fingerprint(a), M.fingerprint(b)) - plain_likeness(a, b)) < 1e-12
    assert M.size_of(M.fingerprint(a)) == len(plain_leaves(a))


def test_ranges():
    assert M.ranges([]) == "" and M.ranges([(0, 1), (0, 2), (0, 4), (1, 5), (2, 6)]) == "0.1-2,0.4,1.5,2.6"


def brute(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out = []
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, n = t or "", n or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        own, changed, other = M.fingerprint(t), M.fingerprint(e), M.fingerprint(n)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), own, changed, plain_likeness(t, e), plain_likeness(t, n), M.ranges(M.differences(own, changed))))
        assert own.partition(":")[0] == plain_print(t)[0] and changed.partition(":")[0] == plain_print(e)[0]
    return out


def same(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS block", "text AS body")
    got = [tuple(r) for r in M.with_next(frame.repartition(3), **options).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(brute(docs), key=key)


def test_blocks(spark):
    docs = [(i * 7 % 1009, f"Text {i}. " * (i % 13) + "\n" * (i % 3)) for i in range(400)]
    for rows in (1, 3, 50, 10_000):
        same(spark, docs, rows_per_block=rows)


def test_edges(spark):
    same(spark, [(5, "only one, and long enough")])
    same(spark, [(1, None), (2, ""), (3, "abcdefgh"), (None, "nothing known"), (10, "é" * 100_000)], rows_per_block=1)
    assert M.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    repeated = spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (2, "bbbb")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in M.with_next(repeated, rows_per_block=1).collect()) == [1, 1, 2]


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in M.op9_fingerprints(spark, sf).collect())
    assert got == sorted(brute(docs))
    assert sum(r[5] for r in got) / len(got) > 0.5 > 0.1 > sum(r[6] for r in got) / len(got)

"""URLs against plain Python, templates against SQL."""

import duckdb
import pytest

from millrace.llm import url_filter as U

URLS = [
    "http://Sub.Example.ORG/es/1?x=/y#z", "https://example.org/en/12", "https://notexample.org/es/", "http://a.com/fr/2", "http://a.com/de/3", "http://a.com/de", "http://a.net/x/y/z", "x://", "://h/p://q/r", "no scheme", "", None,
    "http://u@h.com:80/fr/a b", "http://h?q", "http://h#f", "http://É.org/de/ü", "http://a.org", "http://a.net/\nx",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, url_host string")
    got = {r["page_id"]: r for r in U.filter_urls(pages, "url", U.RULES).collect()}
    for i, u in enumerate(URLS):
        host, path = parse(u)
        want = rule(host, path)
        assert (got[i]["url_host"], got[i]["url_path"]) == (host, path)
        assert got[i]["url_rule"] == (want.text if want else None)
        assert got[i]["url_verdict"] == want.verdict if want else got[i]["url_verdict"] in ("allow", "block")


def test_impure_template_is_rejected(spark):
    rows = [(f"http://h/bad/{i}", 1) for i in range(40)] + [(f"http://h/good/{i}", 0) for i in range(40)] + [("http://h/bad/new", None), ("http://h/good/new", None), ("http://other/x", None)]
    pages = spark.createDataFrame(rows, "url string, label int")
    got = {r["url"]: r for r in U.filter_urls(pages, "url", (), label="label").collect()}
    assert got["http://h/bad/new"]["url_verdict"] == "block" and got["http://h/good/new"]["url_verdict"] == "allow" and got["http://other/x"]["url_verdict"] == "allow"
    assert got["http://h/bad/new"]["url_template"] == "h/bad/*" and got["http://h/bad/new"]["url_purity"] >= 0.8


def test_similar_branches_share_labels(spark):
    rows = [(f"http://h/{b}/{i}", 1) for b in ("a", "b") for i in range(5)] + [("http://h/c/1", None)] * 3
    got = U.filter_urls(spark.createDataFrame(rows, "url string, label int"), "url", (), label="label").where("url LIKE '%/c/%'").collect()
    assert {r["url_verdict"] for r in got} == {"block"}


def test_small_sections_of_a_large_host(spark):
    rows = [(f"http://h/news/{i}", 0) for i in range(2000)] + [(f"http://h/spam/{i}", 1) for i in range(30)] + [(f"http://h/help/{i}", 0) for i in range(5)] + [(f"http://h/shop/{i}", None) for i in range(20)]
    got = U.filter_urls(spark.createDataFrame(rows, "url string, label int"), "url", (), label="label").select("url_template", "url_verdict").distinct().collect()
    assert {tuple(r) for r in got} == {("h/news/*", "allow"), ("h/spam/*", "block"), ("h/help/*", "allow"), ("h/shop/*", "allow")}


def test_labels_differ_below_the_second_segment(spark):
    rows = [(f"http://h/shop/items/{kind}/{i}", int(kind == "spam")) for kind in ("spam", "news") for i in range(30)]
    rows += [(f"http://h/shop/all/by/{kind}/{i}/view", int(kind == "spam")) for kind in ("spam", "news") for i in range(30)]
    rows += [("http://h/shop/items", 0)] * 3 + [("http://h/one/two/three/4/five", None)] * 3 + [("http://h/shop/items/spam/new/", None), ("http://h/shop/all/by/news/99/view", None)]
    got = {r["url"]: r for r in U.filter_urls(spark.createDataFrame(rows, "url string, label int"), "url", (), label="label").collect()}
    assert all(r["url_verdict"] == ("block" if "/spam/" in u else "allow") for u, r in got.items())
    assert got["http://h/shop/items/spam/1"]["url_template"] == "h/shop/items/spam/*" and got["http://h/shop/all/by/news/99/view"]["url_template"] == "h/shop/all/by/news/*/view"
    assert got["http://h/one/two/three/4/five"]["url_template"] == "h/one/two/three/*/five"


def test_branches_are_merged_with_each_other(spark):
    """Two clusters: the few labels of a bad branch count with those of the other bad ones, not with the good ones'."""
    rows = [(f"http://h/{b}/{i}", bad) for b, bad, n in (("a", 0, 400), ("b", 0, 300), ("x", 1, 12), ("y", 1, 9), ("z", 1, 4)) for i in range(n)] + [("http://h/new/1", None)] * 3
    got = {r["url"].split("/")[3]: r for r in U.filter_urls(spark.createDataFrame(rows, "url string, label int"), "url", (), label="label").collect()}
    assert {b: r["url_verdict"] for b, r in got.items()} == {"a": "allow", "b": "allow", "x": "block", "y": "block", "z": "block", "new": "allow"}
    assert got["x"]["url_purity"] == got["y"]["url_purity"] == got["z"]["url_purity"] and got["a"]["url_purity"] == got["b"]["url_purity"]


def test_query_blocks_by_the_method(spark, tmp_path):
    """A host that the rules only block: what no rule covers there is blocked, too; other hosts are not."""
    urls = [f"http://a.com/de/{i}" for i in range(40)] + ["http://a.com/it/1", "http://a.com/it/2", "http://a.com/it/3"] + [f"http://b.com/{x}/{i}" for x in ("de", "fr") for i in range(20)]
    urls += ["http://b.com/it/1", "http://c.net/it/1", "http://c.org/it/1", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in U.op4_url_filter(spark, str(tmp_path)).collect()}
    by = {u: got[i] for i, u in enumerate(urls)}
    assert by["http://a.com/it/2"]["verdict"] == "block" and by["http://a.com/it/2"]["rule"] is None
    assert [by[u]["verdict"] for u in ("http://b.com/it/1", "http://c.net/it/1", "http://c.org/it/1", None)] == ["allow"] * 4
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[1] for r in c.execute(f"SELECT page_id, verdict FROM ({U.OP4_SQL})").fetchall()} == {i: r["verdict"] for i, r in got.items()}


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([("http://a.net/x",)] * 3, "url string")
    assert U.filter_urls(pages, "url", U.RULES).count() == 3 and U.filter_urls(pages.where("false"), "url", U.RULES).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = c.execute(U.OP4_SQL).df()
    got = U.op4_url_filter(spark, sf).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_plan_has_no_python(spark, sf):
    assert "Python" not in U.op4_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()

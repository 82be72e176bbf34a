from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadmill.llm import capture_index as C


@pytest.fixture
def pages(spark):
    urls = ["http://www.Example.com/a/", "https://example.com:443/a#x", "http://example.com/a?b=2&a=1", "http://example.com/a?a=1&b=2", "example.com", "http://u@sub.example.com/", None, "  ", "http://b.org/é\tx", "http://b.org"] + ["http://hot.org/x"] * 25
    return spark.createDataFrame([(i if i != 4 else None, u, "<p>" * (i % 4) if i != 5 else None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")


def test_keys(pages):
    got = [r[0] for r in pages.select(C.url_key(F.col("url"))).collect()][:10]
    assert got == ["com,example)/a", "com,example)/a", "com,example)/a?a=1&b=2", "com,example)/a?a=1&b=2", "com,example)/", "com,example,sub)/", None, None, "org,b)/é\tx", "org,b)/"]


@pytest.mark.parametrize(("lines", "most"), [(1000, 100_000), (3, 100_000), (3, 2), (1, 1)])
def test_lookups_are_those_of_brute_force(pages, lines, most):
    keyed = pages.withColumn("k", C.url_key(F.col("url"))).collect()
    n = Counter(r.k for r in keyed if r.k)
    want = {(r.page_id, r.k, n[r.k] if r.k else 0, len({x.html or "" for x in keyed if x.k == r.k}) if r.k else 0, sum(len(x.html or "") for x in keyed if x.k == r.k) if r.k else 0) for r in keyed}
    got = C.capture_lookup(pages, lines, most).collect()
    assert len(got) == len(keyed) and {(r.page_id, r.url_key, r.n_captures, r.n_versions, r.n_bytes) for r in got} == want


def test_blocks_are_sorted_and_read_by_range(spark, pages):
    path, directory = C.build_index(pages, 3)
    rows = directory.orderBy("part", "block").collect()
    assert all(r.first_key <= r.last_key and r.n_lines <= 3 for r in rows) and sum(r.n_lines for r in rows) == 33
    assert all(a.last_key <= b.first_key for a, b in zip(rows, rows[1:]))
    assert all(b.offset == (a.offset + a.length if a.part == b.part else 0) for a, b in zip(rows, rows[1:]))
    asked = spark.createDataFrame([("org,hot)/x",), ("org,none)/",), (None,), ("org,hot)/x",)], "key string")
    assert C.lookup(asked, path, directory).count() == 25


def test_keys_that_sort_otherwise_once_written(spark):
    urls = ["http://h.org" + x for x in ("/a\tb", "/a!b", "/a$b", "/a%09b", "/a%b", "/a%2509b", "/a\nb", "/a%0ab", "/a0b", "/a b", "/a%25b", "/a\x01b", "/a\rb", "/aé")]
    pages = spark.createDataFrame([(i, u, "x" * i) for i, u in enumerate(urls * 2 + urls[:3])], "page_id bigint, url string, html string")
    keyed = pages.select("page_id", C.url_key(F.col("url")).alias("k")).collect()
    n = Counter(r.k for r in keyed)
    assert len(n) == len(urls)
    for lines, most in ((1, 3), (2, 100), (1000, 100)):
        assert {(r.page_id, r.n_captures) for r in C.capture_lookup(pages, lines, most).collect()} == {(r.page_id, n[r.k]) for r in keyed}


def test_records_are_read_by_range(spark, pages):
    clash = pages.withColumn("captured_at", F.concat(F.lit("2024-01-0"), F.col("page_id") % 9 + 1)).selectExpr("*", "1 as key", "2 as `block.no`", "'f' as file", "'t' as top", "'x' as `_metadata`")
    path, directory = C.build_index(clash, 3)
    keys = pages.select(C.url_key(F.col("url")).alias("key"))
    got = C.fetch(C.lookup(keys, path, directory), path).collect()
    want = [(C_key, r.page_id, r.html or "") for r, C_key in zip(pages.collect(), [x.key for x in keys.collect()]) if C_key]
    assert sorted((r.key, r.page_id or -1, r.html) for r in got) == sorted((k, i or -1, h) for k, i, h in want)
    assert all((r.captured == f"2024-01-0{r.page_id % 9 + 1}") if r.page_id is not None else r.captured == "" for r in got)
    one = C.fetch(C.lookup(keys.where("key = 'org,b)/'"), path, directory), path).collect()
    assert [(r.page_id, r.html) for r in one] == [(9, "<p>")]


def test_long_urls_and_pages(spark):
    rows = [(1, "http://a.org/" + "p" * 200_000, "h" * 3_000_000), (2, "http://a.org/" + "p" * 200_000, None), (3, "http://a.org/q?" + "&".join(f"k{i}" for i in range(20_000)), "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {(r.page_id, r.n_captures, r.n_bytes) for r in C.capture_lookup(df).collect()} == {(1, 2, 3_000_000), (2, 2, 3_000_000), (3, 1, 0)}


def test_empty(pages):
    assert C.capture_lookup(pages.limit(0)).count() == 0
    assert C.capture_lookup(pages.where("url is null")).count() == 1

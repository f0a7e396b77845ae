import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls

NORMAL = [
    ("HTTP://Example.COM:80/a/../b//c/./?b=2&a=1&a=0&a-b=1#f", "http://example.com/b/c/?a=0&a=1&a-b=1&b=2"),
    ("http://x.com", "http://x.com"),
    ("http://x.com/../a", "http://x.com/a"),
    ("http://x.com/a/..", "http://x.com/"),
    ("http://x.com/a/.", "http://x.com/a/"),
    ("http://x.com/a//b///c/", "http://x.com/a/b/c/"),
    ("http://x.com/?z&y=", "http://x.com/?y=&z="),
    ("https://x.com:443/%7euser/%c3%a9", "https://x.com/~user/%C3%A9"),
    ("https://x.com:80/", "https://x.com:80/"),
    ("mailto:x@example.com", "mailto:x@example.com"),
    ("http://x.com/a b?q=a%20b", "http://x.com/a%20b?q=a+b"),
    ("http://x.com/?", "http://x.com/"),
    ("http://www.x.com/a", "http://www.x.com/a"),
    ("http://é.com/é", "http://é.com/%C3%A9"),
    ("http://u:p@X.com/a/..", "http://u:p@x.com/"),
    ("http://x.com/%ff%2f", "http://x.com/%FF%2F"),
    ("http://[::1]:80/", "http://[::1]/"),
    ("", ""),
    ("http://x/%zz", None),
    (":foo", None),
    ("1http://x", None),
    ("http://x.com:80a/", None),
    ("http://x.com/a\tb", None),
    ("http://a b.com/", None),
]

# RFC 3986, section 5.4, against http://a/b/c/d;p?q
RESOLVED = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
    "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
    "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g?y/./x": "http://a/b/c/g?y/./x", "g#s/../x": "http://a/b/c/g#s/../x",
    "http://o.org/x/../y": "http://o.org/y", "/é": "http://a/%C3%A9", "/%zz": None,
}


def test_normal_form_in_both_forms(spark):
    df = spark.createDataFrame([(u,) for u, _ in NORMAL], "url string")
    rows = urls.with_normalized_url(df, output="n").select("url", "n", urls.normalize_url(F.col("url")).alias("m")).collect()
    assert {r.url: r.n for r in rows} == dict(NORMAL)
    assert all(r.n == r.m for r in rows)


def test_normal_form_is_stable(spark):
    df = spark.createDataFrame([(u,) for u, _ in NORMAL], "url string")
    once = urls.with_normalized_url(df).filter("url IS NOT NULL")
    twice = urls.with_normalized_url(once, output="again")
    assert twice.filter("url <> again").count() == 0


def test_resolution_in_all_forms(spark):
    df = spark.createDataFrame([(k,) for k in RESOLVED], "ref string").withColumn("base", F.lit("http://a/b/c/d;p?q"))
    rows = urls.with_resolved_url(df, "base", "ref", "t").select(
        "ref", "t", urls.resolve_url(F.col("base"), F.col("ref")).alias("u")
    )
    for r in rows.collect():
        assert (r.t, r.u) == (RESOLVED[r.ref], RESOLVED[r.ref]), r.ref


def test_parts_and_prefixes(spark):
    df = spark.createDataFrame([("http://u@www.Ex.com:8080/a//b/?q=1#f",)], "url string")
    r = df.select(
        urls.url_parts(F.col("url")).alias("p"),
        urls.prefix_key(F.col("url")).alias("k"),
        urls.prefix_candidates(F.col("url")).alias("c"),
    ).first()
    assert r.p.asDict() == {
        "scheme": "http", "authority": "u@www.Ex.com:8080", "host": "www.Ex.com:8080", "port": "8080",
        "path": "/a//b/", "query": "q=1", "fragment": "f",
    }
    assert r.k == "Ex.com:8080/a//b"
    assert r.c == ["Ex.com:8080", "Ex.com:8080/a", "Ex.com:8080/a/b"]


@pytest.mark.parametrize("raw,expected", [("data:x", True), ("DATA:x", False), (" data:x", False)])
def test_data_urls(spark, raw, expected):
    assert spark.range(1).select(urls.is_data_url(F.lit(raw))).first()[0] is expected

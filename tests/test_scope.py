import pytest
from pyspark.sql import functions as F

from linkloom.functions.urls import plain_place
from linkloom.operators import scope as sc

P = ["http://library.test", "http://shop.test/books/"]
#: a whole host (also as www), everything below one folder, and what only looks like it
UNDER_P = [
    *[(f"http://{www}library.test{tail}", True) for www in ("", "www.") for tail in ("", "/", "/q/r?s")],
    *[(f"http://shop.test/books{tail}", True) for tail in ("", "/", "/1", "/1/2/3", "/a%20b/c", "/x?y=/z")],
    *[(f"http://shop.test{tail}", False) for tail in ("", "/", "/book", "/bookshelf/1", "/toys/books/", "/?to=/books/")],
    *[(url, False) for url in ("http://news.library.test/", "http://test/", "http://library.test.net/")],
]


def check(spark, scope, rows):
    df = spark.createDataFrame([(u, t, d) for u, t, d, _ in rows], "url string, tag int, depth int")
    kept = {(r.url, r.tag, r.depth) for r in scope.filter(df).collect()}
    for u, t, d, expected in rows:
        assert ((u, t, d) in kept) is expected, (u, t, d)


def test_depth(spark):
    check(spark, sc.depth_scope(7), [(f"http://deep.test/{'d/' * d}", 0, d, d < 7) for d in (0, 6, 7, 8)])


def test_scheme(spark):
    rows = [(f"{s}://any.test/http://x", 0, 0, s in ("gopher", "https")) for s in ("http", "https", "gopher", "ws")]
    check(spark, sc.scheme_scope(["gopher", "https"]), rows)


def test_prefixes(spark, monkeypatch):
    rows = [(u, 0, 0, e) for u, e in UNDER_P]
    check(spark, sc.prefix_scope(P), rows)
    as_column = sc.prefix_scope(P).column()
    df = spark.createDataFrame([(u, 0, 0) for u, _ in UNDER_P], "url string, tag int, depth int")
    assert {r.url for r in df.filter(as_column).collect()} == {u for u, e in UNDER_P if e}
    monkeypatch.setattr(sc, "MAX_INLINE_PREFIXES", 0)  # join instead
    check(spark, sc.prefix_scope(P), rows)


def test_semi_join_keeps_every_row(spark):
    df = spark.createDataFrame([("http://library.test/a", i) for i in range(50)] + [("http://no.com/", 0)], "url string, n int")
    keys = spark.createDataFrame([("library.test",)], "prefix string")
    assert sc.semi_join_prefixes(df, keys).count() == 50
    assert sc.semi_join_prefixes(df, keys.limit(0)).count() == 0


def test_broadcast_and_shuffled_prefixes_agree(spark, monkeypatch):
    urls = [f"http://{h}/{a}/{b}%2Fc//d?x" for h in ("www.hub.test", "rare.test", "none.test") for a in range(20) for b in range(5)]
    df = spark.createDataFrame([(u, i) for i, u in enumerate([*urls, None, "http://%zz/", "http://hub.test"])], "url string, n int")
    keys = ["hub.test/3", "hub.test/4/1/c/d", "rare.test/7/2", "rare.test/8//2", "none", None, "hub.test/3"]
    prefixes = spark.createDataFrame([(k,) for k in keys], "prefix string")
    def under(url):
        path = url.replace("http://", "").replace("www.", "").replace("%2F", "/").replace("//", "/").partition("?")[0] + "/"
        return any(k and path.startswith(k + "/") for k in keys)

    expected = {i for i, u in enumerate(urls) if under(u)}
    at_hand = sc.semi_join_prefixes(df, prefixes)
    plan = at_hand._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 5 and "sequence" not in plan  # one lookup a depth, no list repeated
    physical = at_hand._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and "hashpartitioning" not in physical  # no row moves
    assert {r.n for r in at_hand.collect()} == expected and len(expected) == 7
    for hot in (1, 1000):  # beyond the size of a broadcast, with few and with all candidates hot
        monkeypatch.setattr(sc, "BROADCAST_PREFIXES", 0)
        monkeypatch.setattr(sc, "HOT_CANDIDATES", hot)
        assert sorted(r.n for r in sc.semi_join_prefixes(df, prefixes).collect()) == sorted(expected)


def test_columns_of_too_many_prefixes_fail(spark, monkeypatch):
    monkeypatch.setattr(sc, "MAX_COLUMN_PREFIXES", 1)
    df = spark.createDataFrame([("http://library.test/",)], "url string")
    assert df.filter(sc.prefix_scope(P[:1]).column()).count() == 1
    with pytest.raises(Exception, match="use Scope.filter"):
        df.filter(sc.prefix_scope(P).column()).count()


def test_combinations(spark):
    near, related = sc.depth_scope(2), sc.related_scope()
    rows = [("http://a/", t, d) for t in (0, 1) for d in (1, 5)]
    check(spark, sc.all_of(near, related), [(*r, r[1] == 1 and r[2] < 2) for r in rows])
    check(spark, sc.any_of(near, related), [(*r, r[1] == 1 or r[2] < 2) for r in rows])
    check(spark, sc.all_of(), [(*r, True) for r in rows])
    check(spark, sc.any_of(), [(*r, False) for r in rows])
    check(spark, sc.user_scope(lambda u, t, d: d == 5), [(*r, r[2] == 5) for r in rows])


def test_ignore(spark):
    rows = [
        ("http://a/wp-admin/x", 0, 0, False), ("http://a/?replytocom=3", 0, 0, False), ("http://a/css/css/x/css/y", 0, 0, False),
        ("http://a/mine/x", 0, 0, False), ("http://a/ok", 0, 0, True),
    ]
    check(spark, sc.ignore_scope(["/mine/"]), rows)
    check(spark, sc.ignore_scope(defaults=[]), [(u, t, d, True) for u, t, d, _ in rows])


def test_ignore_collection_of_the_session(spark, tmp_path):
    (tmp_path / "own.json").write_text('{"patterns": ["/mine/"]}')
    spark.conf.set(sc.IGNORE_PATH_SETTING, f"{tmp_path}/*.json")
    try:
        check(spark, sc.ignore_scope(), [("http://a/mine/", 0, 0, False), ("http://a/wp-admin/", 0, 0, True)])
    finally:
        spark.conf.unset(sc.IGNORE_PATH_SETTING)


def test_walk_preset(spark):
    scope = sc.site_scope(["http://EXAMPLE.com/a/"], depth=3, excludes=["/skip"])
    rows = [
        ("http://example.com/a/b", 0, 2, True), ("http://example.com/a/b", 0, 3, False), ("http://other.com/i.png", 1, 9, True),
        ("http://other.com/", 0, 0, False), ("ftp://example.com/a/", 0, 0, False), ("http://example.com/a/skip", 0, 0, False),
        ("http://other.com/skip", 1, 0, False),
    ]
    check(spark, scope, rows)
    strict = sc.site_scope(["http://example.com/a/"], exclude_related=True)
    check(spark, strict, [("http://other.com/i.png", 1, 0, False), ("http://example.com/a", 1, 0, True)])


def test_links_preset(spark):
    rows = [("http://s/wp-admin/", 0, 9, True), ("http://s/", 0, 10, False), ("http://o/", 1, 0, False)]
    check(spark, sc.links_scope(["http://s/"]), rows)


@pytest.mark.parametrize("size", [10, 5000])
def test_prefix_scopes_of_any_size_agree(spark, size):
    scope = sc.prefix_scope([f"http://many.test/{i}/" for i in range(size)])
    rows = [("http://many.test/7/x", 0, 9, True), (f"http://many.test/{size}/x", 0, 9, False), ("http://many.test/", 0, 9, False)]
    check(spark, scope, rows)
    check(spark, sc.any_of(scope, sc.depth_scope(3)), [*rows, ("http://other.test/", 0, 2, True)])
    df = spark.createDataFrame([r[:3] for r in rows], "url string, tag int, depth int")
    for whole in (scope, sc.any_of(scope, sc.depth_scope(3))):
        assert [r.url for r in df.filter(whole.column()).collect()] == ["http://many.test/7/x"]


def test_building_a_prefix_scope_runs_nothing(spark):
    broken = spark.range(1).select(F.raise_error(F.lit("read too early")).cast("string").alias("url"))
    assert sc.prefix_scope(broken).column() is not None


def test_urls_in_normal_form_meet_prefixes_as_others_do(spark):
    keys = ["http://www.a.example/", "http://b.example/x/y", "http://c.example//"]
    urls = [h + p + q for h in ("http://a.example", "https://www.b.example", "http://B.example", "http://c.example", "http://d.example")
            for p in ("", "/", "/x", "/x/y", "/x/y/", "/x/y/z", "/x/yz", "/x//y", "/x/y\n") for q in ("", "?a=b", "#f")]
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"] for r in sc.prefix_scope(keys).filter(table).collect()}
    assert got == {r["url"] for r in table.where(sc.prefix_scope(keys).column()).collect()}
    assert "https://www.b.example/x/y/z?a=b" in got and "https://www.b.example/x/yz" not in got
    place = {r[0]: r[1] for r in table.select("url", plain_place(table["url"])).collect()}
    assert place["https://www.b.example/x/y/?a=b"] == "b.example/x/y" and place["http://a.example/x//y"] is None

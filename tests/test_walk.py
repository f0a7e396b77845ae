import os
import uuid

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from linkloom.operators import scope as sc
from linkloom.plans import storage
from linkloom.plans.walk import _State, walk

CORPUS = "url string, status int, location string, content_type string, body string"


def page(url, body="", status=200, location=""):
    return (url, status, location, "text/html", body)


def seeds(spark, *urls):
    return spark.createDataFrame([(u, 0, 0) for u in urls], "url string, tag int, depth int")


def test_endless_chain_stops_at_the_depth_limit(spark):
    pages = [page("http://h", '<a href="/page/1">')] + [page(f"http://h/page/{k}", f'<a href="/page/{k + 1}">') for k in range(1, 9)]
    scope = sc.all_of(sc.scheme_scope(["http"]), sc.seed_scope(["http://h"]), sc.depth_scope(2))
    result = walk(seeds(spark, "http://h"), spark.createDataFrame(pages, CORPUS), scope)
    assert result.saved.count() == 2


def test_redirect_loop_saves_three_pages(spark):
    pages = [page("http://h/", '<a href="/moved">'), page("http://h/moved", "", 302, "/b"), page("http://h/b", '<a href="/">')]
    scope = sc.all_of(sc.scheme_scope(["http"]), sc.depth_scope(10), sc.seed_scope(["http://h/"]))
    result = walk(seeds(spark, "http://h/"), spark.createDataFrame(pages, CORPUS), scope)
    assert {(r.url, r.depth) for r in result.saved.collect()} == {("http://h/", 0), ("http://h/moved", 1), ("http://h/b", 2)}
    assert not storage.exists(spark, f"{result.state_dir}/edges")


def graph(spark):
    """A hub with many links, a ring, and a page reached two ways."""
    edges = [("hub", f"n{k}") for k in range(40)] + [(f"n{k}", f"n{(k * 7 + 1) % 40}") for k in range(40)]
    edges += [("n3", "deep"), ("deep", "hub"), ("deep", "end")]
    links = spark.createDataFrame([(f"http://g/{a}", f"http://g/{b}", 0) for a, b in edges], "src_url string, url string, tag int")
    nodes = ["hub", "deep", *[f"n{k}" for k in range(40)]]
    return links, spark.createDataFrame([page(f"http://g/{n}") for n in nodes], CORPUS)


def rows(result):
    return {tuple(r) for r in result.responses.select("url", "tag", "depth", "parent", "outcome").collect()}


def test_stopped_walk_goes_on_to_the_same_result(spark):
    links, corpus = graph(spark)
    scope = sc.all_of(sc.scheme_scope(["http"]), sc.depth_scope(20))
    start = seeds(spark, "http://g/hub")
    whole = walk(start, corpus, scope, links=links)
    folder = storage.fresh_dir(spark, "walk")
    stopped = walk(start, corpus, scope, links=links, state_dir=folder, max_rounds=1, keep=True)
    assert stopped.visited.count() == 41
    resumed = walk(start, corpus, scope, links=links, state_dir=folder)
    assert rows(resumed) == rows(whole) and len(rows(whole)) == 43
    assert ("http://g/end", 0, 3, "http://g/deep", "retry") in rows(whole)


def test_spreading_a_hub_changes_nothing(spark):
    links, corpus = graph(spark)
    scope = sc.all_of(sc.scheme_scope(["http"]), sc.depth_scope(20))
    start = seeds(spark, "http://g/hub")
    spread = walk(start, corpus, scope, links=links, hot_links=10, keep=True)
    edges = spark.read.parquet(f"{spread.state_dir}/edges")
    assert edges.filter("src_url = 'http://g/hub'").select("slot").distinct().count() == 4
    assert rows(spread) == rows(walk(start, corpus, scope, links=links))


def test_later_attempts_answer_retries(spark):
    schema = CORPUS + ", attempt int"
    corpus = spark.createDataFrame([(*page("http://h/", "", 503), 0), (*page("http://h/", '<a href="/x">'), 1)], schema)
    scope = sc.scheme_scope(["http"])
    once = walk(seeds(spark, "http://h/"), corpus, scope, max_attempts=1)
    every = walk(seeds(spark, "http://h/"), corpus, scope)
    assert (once.visited.count(), every.visited.count()) == (1, 2) and every.complete


def test_handler_makes_the_links(spark):
    corpus = spark.createDataFrame([page("http://h/"), page("http://h/z")], CORPUS)

    def to_z(saved):
        return saved.select(F.col("url").alias("src_url"), F.lit("http://h/z").alias("url"), F.lit(1).alias("tag"))

    result = walk(seeds(spark, "http://h/"), corpus, sc.scheme_scope(["http"]), handler=to_z)
    assert {(r.url, r.tag) for r in result.visited.collect()} == {("http://h/", 0), ("http://h/z", 1)}
    with pytest.raises(ValueError):
        walk(seeds(spark, "http://h/"), corpus, sc.scheme_scope(["http"]), handler=lambda saved: saved)


def test_equal_urls_are_answered_once(spark):
    rows = [(*page("http://h/", '<a href="/two">'), 2), (*page("HTTP://H/", '<a href="/one">'), 1)]
    corpus = spark.createDataFrame(rows, CORPUS + ", id long")
    result = walk(seeds(spark, "http://h/"), corpus, sc.scheme_scope(["http"]), order_by="id")
    assert {r.url for r in result.visited.collect()} == {"http://h/", "http://h/one"}
    assert result.saved.count() == 1


def test_rounds_shuffle_neither_edges_nor_visited(spark, monkeypatch):
    plans = []
    commit = _State.commit_round

    def watched(self, table, k, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        commit(self, table, k, rows)

    monkeypatch.setattr(_State, "commit_round", watched)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links, corpus = graph(spark)
        walk(seeds(spark, "http://g/hub"), corpus, sc.scheme_scope(["http"]), links=links)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scans = [line for line in plans[1].splitlines() if "FileScan" in line and "linkloom_" in line]
    assert len(scans) == 3 and all("Bucketed: true" in line for line in scans)
    # the frontier moves to its edges' buckets, and new candidates to theirs
    assert sum("Exchange hashpartitioning" in line for line in plans[1].splitlines()) <= 3


def chain(spark, n):
    edges = [(f"http://g/{k}", f"http://g/{k + 1}", 0) for k in range(n)] + [(f"http://x/{k}", f"http://x/{k + 1}", 0) for k in range(3000)]
    links = spark.createDataFrame(edges, "src_url string, url string, tag int")
    return links, spark.createDataFrame([page(u) for u, _, _ in edges], CORPUS)


def test_many_small_rounds_read_few_buckets_and_merge_their_runs(spark, monkeypatch):
    plans, runs = [], []
    commit, add = _State.commit_round, _State.add_round

    def watched(self, table, k, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        commit(self, table, k, rows)

    def counted(self, table, k):
        add(self, table, k)
        runs.append(len(self.runs))

    monkeypatch.setattr(_State, "commit_round", watched)
    monkeypatch.setattr(_State, "add_round", counted)
    monkeypatch.setattr("linkloom.plans.walk.LEAST_BUCKET_BYTES", 1 << 12)
    links, corpus = chain(spark, 12)
    result = walk(seeds(spark, "http://g/0"), corpus, sc.scheme_scope(["http"]), links=links, keep=True)
    assert sorted(r.depth for r in result.visited.collect()) == list(range(13))
    edges = [line for line in plans[3].splitlines() if "FileScan" in line and "linkloom_edges" in line]
    assert len(edges) == 1 and "SelectedBucketsCount: 1 out of 8" in edges[0] and "PushedFilters: [IsNotNull(key), EqualTo(key" in edges[0].replace("In(key, [", "EqualTo(key")
    assert max(runs) <= 9 and any(b < a for a, b in zip(runs, runs[1:]))
    # merged runs serve a resumed walk, whose rounds are there already
    again = walk(seeds(spark, "http://g/0"), corpus, sc.scheme_scope(["http"]), links=links)
    assert rows(again) == rows(result)


def test_buckets_follow_the_data_and_not_the_shuffle(spark):
    links, corpus = graph(spark)
    scope = sc.scheme_scope(["http"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = set()
    try:
        for n in ("3", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            state = walk(seeds(spark, "http://g/hub"), corpus, scope, links=links, keep=True).state_dir
            found.add(spark.read.parquet(f"{state}/layout").first()["buckets"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {4}


def test_a_folder_of_another_walk_is_refused_or_rebuilt(spark):
    links, corpus = graph(spark)
    near, far = (sc.all_of(sc.prefix_scope(["http://g"]), sc.depth_scope(n)) for n in (2, 20))
    start, folder = seeds(spark, "http://g/hub"), storage.fresh_dir(spark, "walk")

    def go(scope, corpus=corpus, **options):
        return walk(start, corpus, scope, links=links, state_dir=folder, keep=True, **options)

    assert go(near, max_rounds=1).visited.count() == 41
    with pytest.raises(ValueError, match="another scope"):
        go(far)
    with pytest.raises(ValueError, match="another corpus"):
        go(near, corpus.limit(5))
    # scopes made anew are the same scope
    assert go(sc.all_of(sc.prefix_scope(["http://g"]), sc.depth_scope(2))).visited.count() == 41
    whole = walk(start, corpus, far, links=links)
    assert rows(go(far, on_change="rebuild")) == rows(whole)


def test_scopes_that_decide_alike_describe_alike(spark):
    make = lambda p, x: sc.site_scope(["http://a/"], only_prefixes=p, excludes=x).describe()
    assert make(["http://a/b", "http://c"], ["x"]) == make(["http://c", "http://a/b"], ["x"])
    assert len({make(["http://a"], ["x"]), make(["http://b"], ["x"]), make(["http://a"], ["y"])}) == 3


def test_scope_is_asked_about_few_of_many_equal_links(spark, tmp_path):
    asked = str(tmp_path)

    def counted(urls):
        with open(f"{asked}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(u for u in urls.to_pylist() if u))
        return pc.not_equal(urls, "http://g/no")

    scope = sc.user_scope(lambda url, tag, depth: F.arrow_udf(counted, "boolean")(url), uses_depth=False)
    edges = [("hub", f"n{k}") for k in range(50)] + [(f"n{k}", to) for k in range(50) for to in ("hub", "a", "b", "no")]
    links = spark.createDataFrame([(f"http://g/{a}", f"http://g/{b}", 0) for a, b in edges], "src_url string, url string, tag int")
    corpus = spark.createDataFrame([page(f"http://g/{a}") for a in {a for a, _ in edges}], CORPUS)
    result = walk(seeds(spark, "http://g/hub"), corpus, scope, links=links)
    assert {r.url for r in result.visited.collect()} == {f"http://g/{n}" for n in ["hub", "a", "b", *[f"n{k}" for k in range(50)]]}
    urls = [u for f in os.listdir(asked) for u in open(f"{asked}/{f}").read().split()]
    # of 250 links: the seed, 50 pages, and three targets, none for each link to it
    assert len(urls) <= 60


@pytest.mark.parametrize("hot_links", [2, 1_000_000])
def test_links_in_other_forms_and_of_pages_not_saved(spark, hot_links):
    edges = [
        ("http://g/hub", "http://g/b/../x", 1), ("http://G/hub", "HTTP://g/x", 0), ("http://g:80/hub", "http://g/y", 0),
        ("http://g/y", "http://g/x", 0), ("http://g/hub", "http://g/gone", 0), ("http://g/hub", "http://g/odd%2525", 0),
        ("http://g/gone", "http://g/no", 0), ("http://g/unknown", "http://g/no", 0), (None, "http://g/no", 0),
        ("http://g/y", None, 0), ("http://g/y", "http://[", 0), ("http://g/y", "http://%zz/", 0),
        ("http://g/x", "http://out/side", 0), ("http://g/y", "http://out/side", 1), ("http://g/odd%2525", "http://g/z", 0),
    ]
    links = spark.createDataFrame(edges, "src_url string, url string, tag int")
    pages = [page("http://g/hub"), page("http://g/x"), page("http://g/y"), page("http://g/gone", "", 404), page("http://g/odd%2525")]
    corpus = spark.createDataFrame(pages, CORPUS)
    expected = {
        ("http://g/hub", 0, 0, ""), ("http://g/x", 0, 1, "http://g/hub"), ("http://g/y", 0, 1, "http://g/hub"),
        ("http://g/gone", 0, 1, "http://g/hub"), ("http://g/odd%2525", 0, 1, "http://g/hub"), ("http://g/z", 0, 2, "http://g/odd%2525"),
        ("http://out/side", 1, 2, "http://g/y"),
    }
    # few prefixes are tested in the rounds, more than a thousand on the edges
    for more in (0, 1_500):
        prefixes = ["http://g", *[f"http://other/{k}" for k in range(more)]]
        scope = sc.all_of(sc.any_of(sc.prefix_scope(prefixes), sc.related_scope()), sc.depth_scope(5))
        result = walk(seeds(spark, "http://g/hub"), corpus, scope, links=links, hot_links=hot_links)
        assert {tuple(r) for r in result.visited.collect()} == expected
        assert result.visited.count() == len(expected)

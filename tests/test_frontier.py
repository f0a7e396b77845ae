import datetime as dt

from linkloom.operators import frontier as fr
from linkloom.operators import responses as rs
from linkloom.operators import scope as sc
from linkloom.operators import stats

LOG = "ts timestamp, url string, tag int, depth int, status int, location string, body string"
T0 = dt.datetime(2024, 1, 1)


def log(spark, *rows):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), u, 0, 1, st, loc, b) for s, u, st, loc, b in rows], LOG)


def sample(spark):
    return log(
        spark, (0, "http://a/1", 200, "", "xx"), (1, "http://a/2", 302, "/1", "y"), (2, "http://a/3", 404, "", "zzz"),
        (3, "http://a/4", 429, "", ""), (4, "http://a/5", 500, "", "q"), (20, "http://a/6", None, "", None),
        (30, "http://a/7", 301, "http://%zz/", "r"),
    )


def test_outcomes(spark):
    got = {r.url[-1]: r.outcome for r in rs.classify(sample(spark)).collect()}
    assert got == {"1": "saved", "2": "saved+redirect", "3": "dropped", "4": "retry", "5": "retry", "6": "retry", "7": "saved+redirect"}
    assert {r.url[-1] for r in rs.needs_retry(sample(spark)).collect()} == {"4", "5", "6"}
    assert {r.url[-1] for r in rs.successful(sample(spark)).collect()} == {"1", "2", "7"}
    edges = rs.redirect_edges(sample(spark)).collect()
    assert [(e.src_url, e.url, e.tag, e.depth) for e in edges] == [("http://a/2", "http://a/1", 0, 2)]


def test_statistics(spark):
    r = stats.fetch_stats(sample(spark)).first()
    assert (r.urls, r.bytes) == (6, 4) and abs(r.kb_per_s - 4 / 30 / 1000) < 1e-12
    assert stats.status_map(sample(spark)).first().states == {200: 1, 301: 1, 302: 1, 404: 1, 429: 1, 500: 1}
    running = [(r.urls, r.bytes) for r in stats.stats_every(sample(spark)).orderBy("period_end").collect()]
    assert running == [(5, 3), (6, 4)]
    one = stats.fetch_stats(log(spark, (0, "http://a/", 200, "", "x"))).first()
    assert one.kb_per_s is None


def test_statistics_run_over_days(spark):
    many = log(spark, *[(k * 40_000, f"http://a/{k}", 200, "", "x") for k in range(12)])
    assert [r.urls for r in stats.stats_every(many).orderBy("period_end").collect()] == list(range(1, 13))


def test_first_seen_is_least(spark):
    rows = [("u", 1, 3, "p"), ("u", 0, 3, "z"), ("u", 0, 3, "y"), ("u", 0, 9, "a"), ("v", 1, 0, "q")]
    df = spark.createDataFrame(rows, "url string, tag int, depth int, parent string")
    assert {tuple(r) for r in fr.first_seen(df, "parent").collect()} == {("u", 0, 3, "y"), ("v", 1, 0, "q")}
    assert {tuple(r) for r in fr.first_seen(df).collect()} == {("u", 0, 3), ("v", 1, 0)}


def test_enqueue_twice_adds_nothing(spark):
    df = spark.createDataFrame([("HTTP://a/x#1", 0, 1), ("http://a/x", 0, 2), ("ftp://a/", 0, 0)], "url string, tag int, depth int")
    seen = spark.createDataFrame([], "url string")
    fresh, new = fr.enqueue(df, sc.scheme_scope(["http"]), seen)
    assert [tuple(r) for r in fresh.collect()] == [("http://a/x", 0, 1)]
    again, _ = fr.enqueue(df, sc.scheme_scope(["http"]), seen.unionByName(new))
    assert again.count() == 0


def test_due_order_and_requeue(spark):
    rows = [("b", T0, "pending"), ("a", T0, "pending"), ("c", T0 + dt.timedelta(hours=1), "pending"), ("d", T0, "active")]
    df = spark.createDataFrame(rows, "url string, not_before timestamp, state string")
    assert [r.url for r in fr.due_batch(df, T0).collect()] == ["a", "b"]
    assert [r.url for r in fr.due_batch(fr.requeue_active(df), T0, 1).collect()] == ["a"]
    assert {tuple(r) for r in fr.backlog(df).collect()} == {("pending", 3), ("active", 1)}
    assert fr.requeue_active(df).filter("state = 'active'").count() == 0


def test_due_scan_reads_due_hours_only(spark, tmp_path):
    rows = [(f"u{i % 7}-{i}", 0, 1, T0 + dt.timedelta(minutes=11 * i), "active" if i % 9 == 0 else "pending", 0) for i in range(200)]
    df = spark.createDataFrame([*rows, ("never", 0, 1, None, "pending", 0)], "url string, tag int, depth int, not_before timestamp, state string, attempt int")
    fr.write_frontier(df, f"{tmp_path}/f")
    now = T0 + dt.timedelta(hours=20, minutes=3)
    whole = fr.due_scan(spark, f"{tmp_path}/f", now)
    assert {r.url for r in whole.collect()} == {r.url for r in fr.due_batch(df, now).collect()}
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Sort" not in plan and "Exchange" not in plan
    hours = {(r.not_before - T0).total_seconds() // 3600 for r in df.where("state = 'pending' and not_before is not null").collect()}
    assert len(whole.inputFiles()) > 0 and max(hours) > 30
    for n in (0, 1, 17, 1000):
        first = fr.due_scan(spark, f"{tmp_path}/f", now, n)
        assert [r.url for r in first.collect()] == [r.url for r in fr.due_batch(df, now, n).collect()]
    read = spark.read.parquet(f"{tmp_path}/f").where("state = 'pending'").select("due_hour").distinct().count()
    one = fr.due_scan(spark, f"{tmp_path}/f", now, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert read > 30 and one.count("due_hour") > 0
    fr.write_frontier(df.limit(0), f"{tmp_path}/empty")
    assert fr.due_scan(spark, f"{tmp_path}/empty", now).count() == 0


def test_retry_delay_and_limit(spark):
    r = fr.retry_schedule(sample(spark)).orderBy("url").first()
    assert (r.not_before, r.attempt, r.state) == (T0 + dt.timedelta(seconds=183), 1, "pending")
    assert fr.retry_schedule(sample(spark), max_attempts=1).count() == 0


def test_salted_expansion_equals_plain(spark):
    links = spark.createDataFrame([("hub", f"x{i}", 0) for i in range(200)] + [("h2", "y", 1)], "src_url string, url string, tag int")
    front = spark.createDataFrame([("hub", 4), ("h2", 1)], "url string, depth int")
    plain, salted = fr.expand_frontier(front, links), fr.expand_frontier(front, links, salts=7)
    assert plain.count() == 201 and plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_corpus_keeps_the_least_of_equal_urls(spark):
    df = spark.createDataFrame([(2, "http://a/", "two"), (1, "HTTP://A/", "one"), (3, "http://b/%zz", "bad")], "page_id long, url string, body string")
    assert [r.body for r in fr.unique_corpus(df, "page_id").collect()] == ["one"]

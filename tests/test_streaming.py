import datetime as dt
import hashlib
import time
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from linkloom.operators import frontier, stats
from linkloom.operators import scope as sc
from linkloom.plans import storage
from linkloom.sources import lists, warc
from linkloom.streaming import frontier as streams
from workload import derived, queries

SF = "/root/testdata/sf0.001"


def test_frontier_stream_equals_batch(spark):
    scope = sc.all_of(sc.scheme_scope(["http", "https"]), sc.ignore_scope())
    batch = frontier.first_seen(frontier.candidates_in_scope(derived.raw_urls(spark, SF), scope)).select("url")
    stream = queries.QUERIES["stream_frontier"](spark, SF)
    assert sorted(r.url for r in batch.collect()) == sorted(r.url for r in stream.collect())


def test_stats_stream_equals_batch(spark):
    stream = {r.status: r.urls for r in queries.QUERIES["stream_stats"](spark, SF).collect()}
    assert stream == stats.status_map(derived.fetch_log(spark, SF)).first().states


def test_url_list_as_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("http://a/\nhttp://a/\nhttp://%zz/\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    stream = streams.stream_frontier(lists.checked_urls(lines, "drop"), sc.all_of())
    assert [r.url for r in queries._run(spark, stream).collect()] == ["http://a/"]


def test_ttl_forgets(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    for n, hours in enumerate((0, 1, 50, 100, 150)):
        frame = spark.createDataFrame([(t0 + dt.timedelta(hours=hours), "http://a/", 0, 0)], "ts timestamp, url string, tag int, depth int")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = queries._run(spark, streams.stream_frontier(source, sc.all_of(), ttl="10 hours"))
    # state goes once the clock, which lags a batch, has passed the ttl
    assert [r.ts.day for r in kept.orderBy("ts").collect()] == [1, 7]


def test_retries_come_back_when_due(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, 503), (1, 200), (170, None), (200, 200), (290, 503), (400, 200), (999, 429)]
    for second, status in rows:
        frame = spark.createDataFrame(
            [(t0 + dt.timedelta(seconds=second), f"http://a/{second}", 0, 0, status)] * 2, "ts timestamp, url string, tag int, depth int, status int"
        )
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = queries._run(spark, streams.stream_retries(source))
    # two copies each; the last failure is not due when the log ends
    assert sorted(r.url for r in out.collect()) == sorted(["http://a/0", "http://a/170", "http://a/290"] * 2)
    assert out.filter(F.col("url") == "http://a/0").first().not_before == t0 + dt.timedelta(seconds=180)


def test_late_failures_come_with_their_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    # 600 s and 200 s behind the clock, and one that still has to wait
    batches = [[(1000, 200)], [(400, 503), (800, None), (900, 503)], [(1100, 200)], [(1, 200)]]
    seen = []
    schema = "ts timestamp, url string, tag int, depth int, status int, attempt int"
    for batch in batches:
        rows = [(t0 + dt.timedelta(seconds=s), f"http://a/{s}", None, 3, status, 4) for s, status in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def note(frame, number):
        seen.extend((number, r.url, r.tag, r.depth, r.attempt) for r in frame.collect())

    stream = streams.stream_retries(source).writeStream.foreachBatch(note)
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {s[1:] for s in seen} == {(f"http://a/{s}", None, 3, 5) for s in (400, 800, 900)}
    by_url = {s[1]: s[0] for s in seen}
    assert by_url["http://a/400"] == by_url["http://a/800"] == 1  # the batch they came in
    assert by_url["http://a/900"] > 1


def test_archive_stream_replays_once(spark):
    log = derived.fetch_log(spark, SF)
    out, checkpoint = storage.fresh_dir(spark, "warc"), storage.fresh_dir(spark, "checkpoint")
    source = queries._as_stream(spark, log)
    for _ in range(2):  # the second run finds nothing new
        streams.stream_to_warc(source, out, checkpoint).awaitTermination()
    back = {r.warc_type: r.records for r in queries._records_read_back(spark, f"{out}/*/*.warc.gz").collect()}
    saved = stats.saved_count(log).first().saved
    assert back == {"request": saved, "response": saved}


def test_archive_stream_deals_a_batch_over_tasks(spark, tmp_path):
    # one small file is one partition, whatever its records take to compress
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0, f"http://a/{k}", 200, "text/html", bytearray(b"x")) for k in range(400)]
    log = spark.createDataFrame(rows, "ts timestamp, url string, status int, content_type string, body binary")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.stream_to_warc(source, out, str(tmp_path / "c"), tasks=4).awaitTermination()
    files = warc.manifests(f"{out}/batch={0:010d}")["batch-0-" + hashlib.md5(b"batch-0").hexdigest()[:16] + ".json"].files
    assert sorted(records for _, _, records in files) == [200] * 4
    back = {r.warc_type: r.records for r in queries._records_read_back(spark, f"{out}/*/*.warc.gz").collect()}
    assert back == {"request": 400, "response": 400}


class _Handle:
    """A shard's state as dictionaries, and how often it was written to."""

    def __init__(self):
        self.calls, self.values, self.timers, self.index = 0, {}, set(), None

    def getMapState(self, *_):
        return SimpleNamespace(updateValue=self._put, getValue=self.values.get, removeKey=self.values.pop, containsKey=self.values.__contains__)

    def getValueState(self, *_):
        return SimpleNamespace(exists=lambda: self.index is not None, get=lambda: self.index, update=self._index, clear=lambda: self._index(None))

    def _put(self, key, value):
        self.calls += 1
        self.values[key] = value

    def _index(self, value):
        self.calls += 1
        self.index = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_shard_writes_little_state_however_many_seconds_wait():
    schema = StructType([StructField("url", StringType()), StructField("tag", IntegerType()), StructField("due", LongType())])
    shard, handle = streams._Waiting(["url", "tag", "due"], schema), _Handle()
    shard.init(handle)
    at = lambda clock: SimpleNamespace(getCurrentWatermarkInMs=lambda: clock)

    def expired(clock):
        """What the timer at the end of a second gives, once it has passed."""
        gone = {t for t in handle.timers if t <= clock}
        handle.timers -= gone
        return [r for t in gone for f in shard.handleExpiredTimer((0,), at(clock), None) for r in f.itertuples(index=False)]

    rows = [(f"u{k}", None if k % 3 else k, (7 * k % 12_000) * 1_000_000 + 5) for k in range(12_000)]
    frame = pd.DataFrame(rows, columns=shard.columns).sample(frac=1, random_state=1)
    assert not [f for f in shard.handleInputRows((0,), iter([frame[:6_000], frame[6_000:]]), at(0))]
    assert handle.calls < 20 and len(handle.timers) == 1
    # one that is due already goes on at once
    late = pd.DataFrame([("late", 1, 0)], columns=shard.columns)
    assert [f["url"].tolist() for f in shard.handleInputRows((0,), iter([late]), at(1_000))] == [["late"]]
    got = []
    for clock in (1_000, 50_500, 7_000_000, 7_000_000, 11_999_999):
        new = expired(clock)
        assert all((r.due // 1_000_000 + 1) * 1000 <= clock for r in new)
        got += new
        assert len(got) == clock // 1000
    got += expired(12_000_000)
    assert sorted((r.url, None if pd.isna(r.tag) else int(r.tag), r.due) for r in got) == sorted(rows, key=lambda r: r[0])
    assert not handle.values and not handle.timers and handle.index is None

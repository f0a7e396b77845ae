"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import markup, urls
from linkloom.functions.html_reference import html_links_exact
from linkloom.functions.ignore_list import FAMILIES
from linkloom.functions.regex_match import matches_any
from linkloom.operators import frontier, responses, stats
from linkloom.operators import scope as sc
from linkloom.operators.links import page_links
from linkloom.operators.warc_records import to_warc_records
from linkloom.plans import storage
from linkloom.plans.walk import walk
from linkloom.sources import lists, warc
from linkloom.sources.edges import write_edges
from linkloom.streaming import frontier as streams
from workload import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


# -- URL functions ----------------------------------------------------------


@query
def url_parts(spark, sf):
    df = urls.with_url_parts(D.raw_urls(spark, sf))
    return df.select("id", "parts.scheme", "parts.authority", "parts.host", "parts.port", "parts.path", "parts.query", "parts.fragment")


@query
def normalize_url(spark, sf):
    return urls.with_normalized_url(D.raw_urls(spark, sf)).select("id", "url")


@query
def resolve_url(spark, sf):
    """Every link attribute of every page, resolved one by one."""
    links = D.html_cases(spark, sf).select("id", "url", F.explode_outer(markup.html_links(F.col("html"))).alias("l"))
    raws = links.select("id", "url", F.col("l.raw").alias("raw"))
    return urls.with_resolved_url(raws, "url", "raw", "target").select("id", "raw", "target").filter(F.col("raw").isNotNull())


@query
def prefix_key(spark, sf):
    return D.raw_urls(spark, sf).select("id", urls.prefix_key(F.col("url")).alias("prefix"))


@query
def prefix_candidates(spark, sf):
    df = urls.with_prefix_candidates(D.raw_urls(spark, sf))
    return df.select("id", F.posexplode("candidates").alias("n", "candidate"))


@query
def is_data_url(spark, sf):
    links = D.html_cases(spark, sf).select("id", F.explode_outer(markup.html_links(F.col("html"))).alias("l"))
    return links.groupBy(F.coalesce(urls.is_data_url(F.col("l.raw")), F.lit(False)).alias("is_data")).agg(F.count("*").alias("n"))


# -- link extraction --------------------------------------------------------


def _exploded(df: DataFrame, links) -> DataFrame:
    rows = df.select("id", F.explode_outer(links).alias("l"))
    return rows.filter(F.col("l").isNotNull()).select("id", "l.raw", "l.tag")


@query
def html_links(spark, sf):
    return _exploded(D.html_cases(spark, sf), markup.html_links(F.col("html")))


@query
def html_links_parsed(spark, sf):
    """The same links by a full parser on the executors."""
    return html_links_exact(D.html_cases(spark, sf), "id", "html")


@query
def css_links(spark, sf):
    return _exploded(D.css_cases(spark, sf), markup.css_links(F.col("css")))


@query
def style_links(spark, sf):
    return _exploded(D.html_cases(spark, sf), markup.style_block_links(F.col("html")))


@query
def raw_links(spark, sf):
    pages = D.typed_cases(spark, sf).select("id", F.col("html").alias("body"), "content_type")
    sheets = D.css_cases(spark, sf).select((-F.col("id") - 1).alias("id"), F.col("css").alias("body"), F.lit("text/css").alias("content_type"))
    return _exploded(pages.unionByName(sheets), markup.raw_links(F.col("body"), F.col("content_type")))


@query
def page_links_of_pages(spark, sf):
    return page_links(D.html_cases(spark, sf), body="html", keep=["id"]).select("id", "url", "tag")


@query
def link_targets(spark, sf):
    """How often each host is linked to, by how many pages."""
    links = page_links(D.html_cases(spark, sf), body="html", keep=["id"])
    hosts = urls.with_url_parts(links).select("id", "parts.host", "tag")
    per_page = hosts.groupBy("host", "id").agg(F.count("*").alias("n"), F.sum("tag").alias("r"))
    return per_page.groupBy("host").agg(
        F.sum("n").alias("links"), F.sum("r").alias("related"), F.count("*").alias("pages")
    )


@query
def edge_table(spark, sf):
    """Links written as an edge table (Parquet and CSV) and read back."""
    links = page_links(D.html_cases(spark, sf), body="html").withColumn("depth", F.lit(1))
    folder = storage.fresh_dir(spark, "edges")
    write_edges(links, f"{folder}/parquet")
    back = spark.read.parquet(f"{folder}/parquet")
    write_edges(back.selectExpr("src src_url", "dst url", "tag", "depth"), f"{folder}/csv", "csv")
    text = spark.read.option("header", True).schema("src string, dst string, tag int, depth int").csv(f"{folder}/csv")
    return text.groupBy("src", "tag").agg(F.count("*").alias("n"), F.max("dst").alias("last"), F.max("depth").alias("depth"))


# -- scopes -----------------------------------------------------------------


def _normal_raw(spark, sf) -> DataFrame:
    return urls.with_normalized_url(D.raw_urls(spark, sf))


def _in_scope(spark, sf, scope: sc.Scope) -> DataFrame:
    return scope.filter(_normal_raw(spark, sf)).select("id")


def _nation_prefixes(spark, sf) -> DataFrame:
    """One folder prefix per supplier, in the shape of a URL."""
    return D.table(spark, sf, "supplier").select(
        F.concat(F.lit("http://www.h"), F.col("s_suppkey").cast("string"), F.lit(".example.com/cat/"), F.col("s_nationkey").cast("string"), F.lit("/")).alias("url")
    )


@query
def depth_scope(spark, sf):
    return _in_scope(spark, sf, sc.depth_scope(10))


@query
def scheme_scope(spark, sf):
    return _in_scope(spark, sf, sc.scheme_scope(["http", "ftp"]))


@query
def related_scope(spark, sf):
    return _in_scope(spark, sf, sc.related_scope())


@query
def all_of(spark, sf):
    return _in_scope(spark, sf, sc.all_of(sc.depth_scope(10), sc.scheme_scope(["https"]), sc.all_of()))


@query
def any_of(spark, sf):
    return _in_scope(spark, sf, sc.any_of(sc.depth_scope(3), sc.related_scope(), sc.any_of()))


@query
def user_scope(spark, sf):
    long_or_near = sc.user_scope(lambda url, tag, depth: (F.length(url) > 40) | (depth == 0))
    return _in_scope(spark, sf, long_or_near)


@query
def prefix_scope(spark, sf):
    keys = _nation_prefixes(spark, sf)
    return sc.prefix_scope(keys).filter(D.many_urls(spark, sf)).groupBy("url").agg(F.count("*").alias("n"))


@query
def seed_scope(spark, sf):
    """Raw URLs below any page of the corpus."""
    return _in_scope(spark, sf, sc.seed_scope(D.table(spark, sf, "pages").select("url")))


@query
def ignore_scope(spark, sf):
    return sc.ignore_scope().filter(D.many_urls(spark, sf)).groupBy("url").agg(F.count("*").alias("n"))


@query
def ignore_families(spark, sf):
    """What each bundled family of the ignore list catches."""
    both = D.many_urls(spark, sf).unionByName(_normal_raw(spark, sf).select("url")).filter(F.col("url").isNotNull())
    hits = both.groupBy("url").agg(F.count("*").alias("n"))
    named = [F.when(matches_any(F.col("url"), patterns), family) for family, patterns in FAMILIES.items()]
    caught = hits.select("n", F.array_compact(F.array(*named)).alias("families"))
    return caught.select("n", F.explode_outer("families").alias("family")).filter(F.col("family").isNotNull()).groupBy("family").agg(F.sum("n").alias("urls"))


@query
def site_scope(spark, sf):
    scope = sc.site_scope(D.table(spark, sf, "pages").select("url"), depth=12, excludes=[r"utm_source="])
    return _in_scope(spark, sf, scope)


@query
def links_scope(spark, sf):
    return _in_scope(spark, sf, sc.links_scope(D.table(spark, sf, "pages").select("url")))


@query
def semi_join_prefixes(spark, sf):
    keys = _nation_prefixes(spark, sf).select(urls.prefix_key(F.col("url")).alias("prefix"))
    return sc.semi_join_prefixes(D.many_urls(spark, sf), keys).groupBy("url").agg(F.count("*").alias("n"))


# -- list sources -----------------------------------------------------------


@query
def read_url_list(spark, sf):
    folder = storage.fresh_dir(spark, "urls")
    D.raw_urls(spark, sf).select("url").write.text(folder)
    return lists.read_url_list(spark, folder)


@query
def read_exclude_patterns(spark, sf):
    """URLs left after excluding one host per nation, from a pattern file."""
    folder = storage.fresh_dir(spark, "excludes")
    hosts = D.table(spark, sf, "nation").select(F.concat(F.lit(r"^http://h"), F.col("n_nationkey").cast("string"), F.lit(r"\.example")))
    hosts.write.text(folder)
    scope = sc.ignore_scope(lists.read_exclude_patterns(spark, folder), defaults=[])
    return scope.filter(D.many_urls(spark, sf)).groupBy("url").agg(F.count("*").alias("n"))


@query
def read_ignore_json(spark, sf):
    """Imported pattern files, and the order lines whose URL each pattern hits."""
    folder = storage.fresh_dir(spark, "ignores")
    nations = D.table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list(F.concat(F.lit(r"/cat/\d*"), F.col("n_nationkey").cast("string"), F.lit("/")))).alias("patterns")
    )
    broken = F.array(F.lit(r"/(.*)/\1/"), F.lit("a(?!b)"))
    nations.select(F.concat("patterns", broken).alias("patterns")).write.option("maxRecordsPerFile", 1).json(folder)
    found = lists.read_ignore_json(spark, f"{folder}/*.json").filter(F.col("error").isNull()).select("pattern").distinct()
    hits = sc.ignore_scope([r["pattern"] for r in found.collect()], defaults=[])
    kept = hits.filter(D.many_urls(spark, sf))
    return kept.groupBy("url").agg(F.count("*").alias("n"))


@query
def seeds(spark, sf):
    """Seeds of the shop with everything they link to directly."""
    keys = D.table(spark, sf, "region").select("r_regionkey").collect()
    given = lists.seeds_df(spark, [f"{D.SHOP}/region/{r.r_regionkey}" for r in keys])
    return frontier.expand_frontier(given, D.site_links(spark, sf)).select("url", "tag", "depth", "parent")


# -- response handling ------------------------------------------------------


@query
def needs_retry(spark, sf):
    return responses.needs_retry(D.fetch_log(spark, sf)).select("event_id", "url", "status", "error")


@query
def successful(spark, sf):
    return responses.successful(D.fetch_log(spark, sf)).select("event_id", "url", "status")


@query
def redirect_edges(spark, sf):
    return responses.redirect_edges(D.fetch_log(spark, sf))


@query
def classify(spark, sf):
    return responses.classify(D.fetch_log(spark, sf)).select("event_id", "outcome")


@query
def handler(spark, sf):
    """A user handler that links every saved response to its site's front page."""

    def to_front(saved: DataFrame) -> DataFrame:
        front = F.regexp_extract("url", "^(https?://[^/]+)", 1)
        return saved.select(F.col("url").alias("src_url"), F.concat(front, F.lit("/")).alias("url"), F.lit(0).alias("tag"))

    return responses.handle(D.fetch_log(spark, sf), to_front).groupBy("url").agg(F.count("*").alias("n"))


# -- frontier ---------------------------------------------------------------


def _seen(spark, sf) -> DataFrame:
    """URLs of successful fetches, as the set already seen."""
    return responses.successful(D.fetch_log(spark, sf)).select("url").distinct()


@query
def first_seen(spark, sf):
    return frontier.first_seen(D.fetch_log(spark, sf))


@query
def first_seen_parent(spark, sf):
    links = D.site_links(spark, sf).withColumn("depth", F.length("src_url"))
    return frontier.first_seen(links, parent="src_url")


@query
def anti_join_seen(spark, sf):
    failed = responses.needs_retry(D.fetch_log(spark, sf)).select("url").distinct()
    return frontier.anti_join_seen(failed, _seen(spark, sf))


@query
def expand_frontier(spark, sf):
    start = D.table(spark, sf, "orders").select(
        D._address("order", "o_orderkey").alias("url"), F.length("o_orderstatus").alias("depth")
    )
    out = frontier.expand_frontier(start, D.site_links(spark, sf), salts=4)
    return out.groupBy("url", "tag", "depth").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))


@query
def enqueue(spark, sf):
    candidates = D.raw_urls(spark, sf).select("url", "tag", "depth")
    seen = urls.with_normalized_url(D.table(spark, sf, "pages").select("url"))
    scope = sc.all_of(sc.scheme_scope(["http", "https"]), sc.depth_scope(14), sc.ignore_scope())
    fresh, _ = frontier.enqueue(candidates, scope, seen)
    return fresh.select("url", "tag", "depth")


@query
def due_batch(spark, sf):
    rows = D.frontier_rows(spark, sf)
    now = rows.agg(F.min("not_before").alias("t")).select(F.col("t") + F.expr("INTERVAL 10 DAYS")).first()[0]
    return frontier.due_batch(rows, F.lit(now), 100).select("url", _stamp("not_before"))


@query
def due_scan(spark, sf):
    """All rows due in the first ten days, from a frontier stored by due time."""
    rows, folder = D.frontier_rows(spark, sf), storage.fresh_dir(spark, "frontier")
    now = rows.agg(F.min("not_before").alias("t")).select(F.col("t") + F.expr("INTERVAL 10 DAYS")).first()[0]
    frontier.write_frontier(rows, folder)
    return frontier.due_scan(spark, folder, now).select("url", _stamp("not_before"), "attempt")


@query
def retry_schedule(spark, sf):
    return frontier.retry_schedule(D.fetch_log(spark, sf)).select("url", "tag", "depth", _stamp("not_before"), "state", "attempt")


@query
def requeue_active(spark, sf):
    rows = frontier.requeue_active(D.frontier_rows(spark, sf))
    return rows.groupBy("state", "attempt").agg(F.count("*").alias("n"))


@query
def backlog(spark, sf):
    return frontier.backlog(D.frontier_rows(spark, sf))


@query
def lookup_responses(spark, sf):
    """The fetch log's URLs and page URLs, looked up in the captured pages."""
    wanted = D.raw_urls(spark, sf).select("url").unionByName(D.fetch_log(spark, sf).select("url"))
    rows = urls.with_normalized_url(wanted).filter(F.col("url").isNotNull()).distinct()
    corpus = frontier.unique_corpus(frontier.page_corpus(D.table(spark, sf, "pages")), "page_id")
    return frontier.lookup_responses(rows, corpus).select("url", "page_id", "outcome")


def _shop_walk(spark, sf, **options):
    scope = sc.site_scope(D.site_seeds(spark, sf), only_prefixes=[D.SHOP])
    return walk(D.site_seeds(spark, sf), D.site_responses(spark, sf), scope, links=D.site_links(spark, sf), **options)


@query
def walk_bfs(spark, sf):
    """The shop walked to a fixpoint, with each URL's depth, parent and outcome."""
    return _shop_walk(spark, sf).responses.select("url", "tag", "depth", "parent", "outcome")


@query
def walk_resume(spark, sf):
    """The same walk stopped after two rounds and started again."""
    folder = storage.fresh_dir(spark, "walk")
    _shop_walk(spark, sf, state_dir=folder, max_rounds=2, keep=True)
    result = _shop_walk(spark, sf, state_dir=folder)
    return result.responses.select("url", "tag", "depth", "outcome")


@query
def walk_pages(spark, sf):
    """Captured pages as seeds: links of their bodies, two steps deep."""
    pages = D.table(spark, sf, "pages")
    scope = sc.all_of(sc.scheme_scope(["http", "https"]), sc.depth_scope(2))
    start = pages.select("url", F.lit(0).alias("tag"), F.lit(0).alias("depth"))
    result = walk(start, frontier.page_corpus(pages), scope, order_by="page_id")
    return result.responses.select("url", "tag", "depth", "outcome")


# -- statistics -------------------------------------------------------------


@query
def fetch_stats(spark, sf):
    return stats.fetch_stats(D.fetch_log(spark, sf))


@query
def status_histogram(spark, sf):
    return stats.status_histogram(D.fetch_log(spark, sf))


@query
def status_map(spark, sf):
    return stats.status_map(D.fetch_log(spark, sf)).select(F.explode("states").alias("status", "urls"))


@query
def stats_every(spark, sf):
    return stats.stats_every(D.fetch_log(spark, sf)).select(_stamp("period_end"), "urls", "bytes")


@query
def stats_every_by_status(spark, sf):
    return stats.stats_every(D.fetch_log(spark, sf), by_status=True).select(_stamp("period_end"), "status", "urls", "bytes")


@query
def stats_report(spark, sf):
    """The running report with each period's share and the rate so far."""
    return stats.stats_report(D.fetch_log(spark, sf)).select(_stamp("period_end"), "urls", "bytes", "period_urls", "period_bytes", "kb_per_s")


@query
def bytes_read(spark, sf):
    return stats.bytes_read(D.fetch_log(spark, sf))


@query
def saved_count(spark, sf):
    return stats.saved_count(D.fetch_log(spark, sf))


# -- archives ---------------------------------------------------------------


def _saved_log(spark, sf) -> DataFrame:
    return responses.successful(D.fetch_log(spark, sf))


@query
def warc_records(spark, sf):
    records = to_warc_records(_saved_log(spark, sf))
    return records.select(
        "record_id", "warc_type", "target_uri", _stamp("date"), "content_type", "content_length",
        F.md5("payload").alias("payload_md5"),
    )


@query
def warc_files(spark, sf):
    """Saved responses written as archive files; records counted back per file type."""
    warc.register(spark)
    folder = storage.fresh_dir(spark, "warc")
    to_warc_records(_saved_log(spark, sf)).write.format("warc").option("maxBytes", 100_000).mode("append").save(folder)
    return _records_read_back(spark, warc.committed_files(folder))


@query
def warc_reruns(spark, sf):
    """The same archive job run twice, after one that no manifest names: records count once."""
    warc.register(spark)
    folder = storage.fresh_dir(spark, "warc")
    records = to_warc_records(_saved_log(spark, sf))
    for job in ("killed", "daily", "daily"):
        records.write.format("warc").options(maxBytes=1_000_000, jobId=job).mode("append").save(folder)
        if job == "killed":  # as if the driver had died before its manifest
            storage.remove_tree(spark, f"{folder}/{warc.MANIFESTS}")
    return _records_read_back(spark, warc.committed_files(folder))


def _records_read_back(spark, path) -> DataFrame:
    """Record types and payload sizes of archive files."""
    files = spark.read.text(path, lineSep="WARC/1.0\r\n")
    kind = F.regexp_extract("value", r"(?m)^WARC-Type: (\w+)", 1)
    size = F.regexp_extract("value", r"(?m)^Content-Length: (\d+)", 1)
    records = files.select(kind.alias("warc_type"), size.alias("size")).filter((F.col("warc_type") != "") & (F.col("warc_type") != "warcinfo"))
    return records.groupBy("warc_type").agg(F.count("*").alias("records"), F.sum(F.col("size").cast("long")).alias("bytes"))


# -- streams ----------------------------------------------------------------


def _as_stream(spark, df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written and read as a stream of four micro-batches, each of as many files as there are cores for."""
    folder = folder or storage.fresh_dir(spark, "stream")
    files = max(1, spark.sparkContext.defaultParallelism // 4)
    df.repartition(4 * files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _run_restarted(spark, df: DataFrame, order: str, make) -> DataFrame:
    """Run ``make(stream)`` over half of ``df``, stop, and go on from its checkpoint over the rest."""
    folder, out, checkpoint = (storage.fresh_dir(spark, n) for n in ("stream", "sink", "checkpoint"))
    half = F.pmod(F.xxhash64(order), F.lit(2))
    for part in range(2):
        stream = make(_as_stream(spark, df.where(half == part), folder))
        writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _run(spark, stream: DataFrame) -> DataFrame:
    """Run a stream to its end into Parquet and read it back."""
    out, checkpoint = storage.fresh_dir(spark, "sink"), storage.fresh_dir(spark, "checkpoint")
    started = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_frontier(spark, sf):
    scope = sc.all_of(sc.scheme_scope(["http", "https"]), sc.ignore_scope())
    stream = _as_stream(spark, D.raw_urls(spark, sf))
    return _run(spark, streams.stream_frontier(stream, scope)).select("url")


@query
def stream_frontier_restart(spark, sf):
    """The same stream stopped half way; URLs seen before the restart stay seen."""
    scope = sc.all_of(sc.scheme_scope(["http", "https"]), sc.ignore_scope())
    return _run_restarted(spark, D.raw_urls(spark, sf), "id", lambda s: streams.stream_frontier(s, scope)).select("url")


@query
def stream_retries_restart(spark, sf):
    """Retries stopped half way; what waited in state comes back after the restart."""
    out = _run_restarted(spark, D.fetch_log(spark, sf), "event_id", streams.stream_retries)
    return out.select("url", "tag", "depth", _stamp("not_before"), "state", "attempt")


@query
def stream_stats(spark, sf):
    stream = _as_stream(spark, D.fetch_log(spark, sf))
    checkpoint = storage.fresh_dir(spark, "checkpoint")
    name = "stats_" + checkpoint.rpartition("-")[2]
    started = streams.stream_stats(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.table(name)


@query
def stream_retries(spark, sf):
    """Four micro-batches whose files are in no time order, so most rows come late."""
    stream = _as_stream(spark, D.fetch_log(spark, sf))
    return _run(spark, streams.stream_retries(stream)).select("url", "tag", "depth", _stamp("not_before"), "state", "attempt")


@query
def stream_to_warc(spark, sf):
    stream = _as_stream(spark, D.fetch_log(spark, sf))
    out, checkpoint = storage.fresh_dir(spark, "warc"), storage.fresh_dir(spark, "checkpoint")
    streams.stream_to_warc(stream, out, checkpoint).awaitTermination()
    batches = spark.read.text(f"{out}/*/{warc.MANIFESTS}/*.json").select(F.input_file_name().alias("f")).distinct().collect()
    folders = sorted(r.f.removeprefix("file://").partition(f"/{warc.MANIFESTS}/")[0] for r in batches)
    return _records_read_back(spark, [f for folder in folders for f in warc.committed_files(folder)])

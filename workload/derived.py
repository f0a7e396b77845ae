"""Tables derived from the driver's: capture-shaped data of the same size.

Every table is a projection (or, for the site, a union of projections) of whole
driver tables, so it grows with them.  ``workload/oracle.py`` states the same
tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.plans import storage

SHOP = "http://shop.example.com"
ASSETS = "http://img.example.net"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; one of fewer files and row groups than there are cores is spread over them.

    (A small table is one file with one row group, which is one task.  Row groups are
    read by tasks of their own, so a large table in one file needs no shuffle.)
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    spread = len(files) < cores and storage.row_groups(spark, files) < cores
    return df.repartition(cores) if spread else df


def raw_urls(spark: SparkSession, sf: str) -> DataFrame:
    """``id, url, tag, depth``: page URLs disturbed in twelve ways."""
    u, n = F.col("url"), F.col("page_id") % 12
    bare = F.regexp_replace(u, r"[?#].*$", "")
    origin = F.regexp_extract(u, r"^(https?://[^/]+)", 1)
    rest = F.substring(u, F.length(origin) + 1, F.length(u))
    port = F.when(u.startswith("https:"), ":443").otherwise(":80")
    url = (
        F.when(n == 0, u)
        .when(n == 1, F.concat(F.upper(origin), rest))
        .when(n == 2, F.concat(origin, port, rest))
        .when(n == 3, F.concat(origin, F.lit("//x/"), rest))
        .when(n == 4, F.concat(origin, F.lit("/a/../b/./c/.."), rest))
        .when(n == 5, F.concat(u, F.lit("#frag")))
        .when(n == 6, F.concat(bare, F.lit("?b=2&a=1&a=0&a-b=1&z")))
        .when(n == 7, F.concat(bare, F.lit("/wp-admin/")))
        .when(n == 8, F.concat(bare, F.lit("?replytocom=1")))
        .when(n == 9, F.concat(F.lit("mailto:u"), F.col("page_id").cast("string"), F.lit("@example.com")))
        .when(n == 10, F.regexp_replace(u, "^https?", "ftp"))
        .otherwise(F.concat(bare, F.lit("/%7euser/%c3%a9")))
    )
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        url.alias("url"),
        F.when(F.col("page_id") % 5 == 0, 1).otherwise(0).alias("tag"),
        (F.col("page_id") % 15).cast("int").alias("depth"),
    )


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    """A fetch log made of the event stream."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind, n = F.col("event_type"), F.col("event_id") % 4
    status = (
        F.when(kind.isin("view", "purchase"), 200)
        .when(kind == "click", 302)
        .when(kind == "signup", 404)
        .when(n == 0, 429)
        .when(n == 1, F.lit(None))
        .otherwise(503)
    )
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(
            F.lit("http://host"), F.col("user_id").cast("string"), F.lit(".example.com/p/"), k.cast("string")
        ).alias("url"),
        F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("tag"),
        (F.col("event_id") % 15).cast("int").alias("depth"),
        status.cast("int").alias("status"),
        F.when(status.isNull(), "timeout").alias("error"),
        F.when(kind == "click", F.concat(F.lit("/p/"), ((k + 1) % 100).cast("string"))).otherwise("").alias("location"),
        F.lit("text/html").alias("content_type"),
        F.repeat(F.lit("x"), F.floor(F.col("value")).cast("int")).cast("binary").alias("body"),
    )


def many_urls(spark: SparkSession, sf: str) -> DataFrame:
    """One URL per order line, two kinds of which the ignore list knows."""
    tail = (
        F.when(F.col("l_linenumber") == 1, "/wp-admin/")
        .when(F.col("l_linenumber") == 2, "?replytocom=1")
        .otherwise("/item.html?id=7")
    )
    return table(spark, sf, "lineitem").select(
        F.concat(
            F.lit("http://h"), F.col("l_suppkey").cast("string"),
            F.lit(".example.com/cat/"), F.col("l_partkey").cast("string"), tail,
        ).alias("url")
    )


#: markup appended to every page; {id} is the page's id
EXTRA_HTML = (
    "<A HREF=/u{id}>x</A><link rel=stylesheet href='/c.css?a=1&amp;b=2'><img alt=\"a>b\" src=\"../img/{id}.png\">"
    "<script src=//cdn.example.com/s.js>var x='<a href=\"/no1\">';</script><iframe src=\"frame?id={id}\"></iframe>"
    "<source src=v.mp4><object data=\"/o.swf\"></object><a href=\"\">e</a><img src=\"data:image/png;base64,AA==\">"
    "<!-- <a href=\"/no2\"> --><noscript><img src=\"/no3\"></noscript><a href=\"/img/same\"><img src=\"/img/same\"></a>"
    "<style type=\"text/css\">p{{background:url('/bg{id}.png')}}\n@import url(x.css);</style>"
    "<a title='<a href=\"/no4\">' href=\"http://other.example.org/a/./b/../c?q#f\">y</a><a href=?page={id}>z</a>"
    "<a href=\"#top\">t</a><a name=q>n</a>"
)


def _filled(template: str, key: str) -> F.Column:
    parts = template.replace("{{", "\0").replace("}}", "\1").split("{id}")
    parts = [F.lit(p.replace("\0", "{").replace("\1", "}")) for p in parts]
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.col(key).cast("string"), p]
    return F.concat(*out)


def html_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with markup of every kind added, all served as HTML."""
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        "url",
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.col("html"), _filled(EXTRA_HTML, "page_id")).alias("html"),
    )


def typed_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The same pages, a third served as plain text: what becomes of content types."""
    mixed = F.when(F.col("id") % 3 == 2, "text/plain").otherwise(F.col("content_type"))
    return html_cases(spark, sf).withColumn("content_type", mixed)


EXTRA_CSS = (
    "a{{background:url(/one{id}.png)}}\nb{{background:url('/two.png') url(\"/three.png\")}} i{{c:d}}\n"
    "@import url(x{id}.css);\r\n@import \"y.css\";\np{{color:red}} q{{background : url( 'sp.png' )}}\n"
)


def css_cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), "url", F.concat(_filled(EXTRA_CSS, "page_id"), F.col("html")).alias("css")
    )


def frontier_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A frontier as a stopped walk would leave it."""
    return fetch_log(spark, sf).select(
        "url",
        "tag",
        "depth",
        F.col("ts").alias("not_before"),
        F.when(F.col("event_id") % 10 == 0, "active").otherwise("pending").alias("state"),
        (F.col("event_id") % 3).cast("int").alias("attempt"),
    )


def _address(kind: str, key: str, host: str = SHOP) -> F.Column:
    return F.concat(F.lit(f"{host}/{kind}/"), F.col(key).cast("string"))


def site_links(spark: SparkSession, sf: str) -> DataFrame:
    """The shop as a web site: one page per row of its tables, links along the keys."""

    def edges(name: str, src: F.Column, dst: F.Column, tag: int) -> DataFrame:
        return table(spark, sf, name).select(src.alias("src_url"), dst.alias("url"), F.lit(tag).alias("tag"))

    return (
        edges("nation", _address("region", "n_regionkey"), _address("nation", "n_nationkey"), 0)
        .unionByName(edges("customer", _address("nation", "c_nationkey"), _address("customer", "c_custkey"), 0))
        .unionByName(edges("orders", _address("customer", "o_custkey"), _address("order", "o_orderkey"), 0))
        .unionByName(edges("lineitem", _address("order", "l_orderkey"), _address("part", "l_partkey"), 0))
        .unionByName(edges("lineitem", _address("part", "l_partkey"), _address("supplier", "l_suppkey", ASSETS), 1))
        .unionByName(edges("supplier", _address("supplier", "s_suppkey", ASSETS), _address("nation", "s_nationkey"), 0))
    )


def site_responses(spark: SparkSession, sf: str) -> DataFrame:
    """What each page of the shop answers."""

    def answers(name: str, url: F.Column, status: F.Column, location: F.Column) -> DataFrame:
        return table(spark, sf, name).select(
            url.alias("url"),
            status.cast("int").alias("status"),
            location.alias("location"),
            F.lit("text/html").alias("content_type"),
            F.lit("").alias("body"),
        )

    ok, nowhere, state = F.lit(200), F.lit(""), F.col("o_orderstatus")
    order = F.when(state == "P", 503).when(state == "O", 302).otherwise(200)
    back = F.when(state == "O", F.concat(F.lit("/customer/"), F.col("o_custkey").cast("string"))).otherwise("")
    return (
        answers("region", _address("region", "r_regionkey"), ok, nowhere)
        .unionByName(answers("nation", _address("nation", "n_nationkey"), ok, nowhere))
        .unionByName(
            answers("customer", _address("customer", "c_custkey"), F.when(F.col("c_acctbal") < 0, 404).otherwise(200), nowhere)
        )
        .unionByName(answers("orders", _address("order", "o_orderkey"), order, back))
        .unionByName(answers("part", _address("part", "p_partkey"), ok, nowhere))
        .unionByName(answers("supplier", _address("supplier", "s_suppkey", ASSETS), ok, nowhere))
    )


def site_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(
        _address("region", "r_regionkey").alias("url"), F.lit(0).alias("tag"), F.lit(0).alias("depth")
    )

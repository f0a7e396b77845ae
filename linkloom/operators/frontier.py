"""The frontier: candidates, first-seen de-duplication, due order, retries.

Columns: ``url, tag, depth`` and, where time matters, ``not_before``, ``state``
('pending' or 'active') and ``attempt``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import with_normalized_url
from linkloom.operators.responses import is_retry, outcome
from linkloom.operators.scope import Scope
from linkloom.operators.skew import salted_join

#: time before a failed request comes back
RETRY_DELAY = "180 seconds"


def first_seen(df: DataFrame, parent: str | None = None) -> DataFrame:
    """One row per URL: the least depth, then tag, then parent.

    Rows are reduced before the shuffle, so a URL that most pages link to costs
    one row per task.  Without a parent the order is packed in one long, which
    keeps the aggregation hash-based.
    """
    if parent is None:
        order = F.shiftleft(F.col("depth").cast("long"), 32) + F.col("tag").cast("long")
        best = df.groupBy("url").agg(F.min(order).alias("o"))
        return best.select(
            "url",
            F.col("o").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("tag"),
            F.shiftright("o", 32).cast("int").alias("depth"),
        )
    best = df.groupBy("url").agg(F.min(F.struct("depth", "tag", parent)).alias("o"))
    return best.select("url", "o.tag", "o.depth", f"o.{parent}")


def anti_join_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose URL has not been seen."""
    return candidates.join(seen.select("url"), "url", "left_anti")


def expand_frontier(frontier: DataFrame, links: DataFrame, salts: int = 1) -> DataFrame:
    """Outlinks of every frontier URL, one step deeper: ``url, tag, depth, parent``.

    ``salts`` > 1 spreads pages with very many links over that many tasks.
    """
    sources = frontier.select(F.col("url").alias("src_url"), "depth")
    edges = links.select("src_url", F.col("url").alias("dst"), "tag")
    joined = salted_join(edges, sources, ["src_url"], "inner", ["dst"], salts)
    return joined.select(
        F.col("dst").alias("url"), "tag", (F.col("depth") + 1).alias("depth"), F.col("src_url").alias("parent")
    )


def candidates_in_scope(candidates: DataFrame, scope: Scope) -> DataFrame:
    """Candidates in normal form and in scope (tested on the normal form)."""
    normal = with_normalized_url(candidates).filter(F.col("url").isNotNull())
    return scope.filter(normal)


def enqueue(
    candidates: DataFrame, scope: Scope, seen: DataFrame, parent: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """New frontier rows, and the URLs to add to ``seen``.

    The scope comes first, so a link out of scope is not remembered as seen.
    """
    fresh = anti_join_seen(first_seen(candidates_in_scope(candidates, scope), parent), seen)
    return fresh, fresh.select("url")


def due_batch(frontier: DataFrame, now: datetime | Column, n: int | None = None) -> DataFrame:
    """Pending rows due at ``now``, earliest first; at most ``n`` if given."""
    moment = now if isinstance(now, Column) else F.lit(now)
    due = frontier.filter((F.col("state") == "pending") & (F.col("not_before") <= moment))
    ordered = due.orderBy("not_before", "url")
    return ordered if n is None else ordered.limit(n)


FRONTIER = "url string, tag int, depth int, not_before timestamp, attempt int"


def _due_hour(moment: Column) -> Column:
    """Hours since 1970, whatever the session's time zone."""
    return F.floor(F.unix_seconds(moment) / 3600)


def write_frontier(frontier: DataFrame, path: str, mode: str = "error") -> None:
    """A frontier laid out by due time: a folder for each state and hour due, its files in due order.

    Rows are dealt by ranges of due time and URL, so an hour in which very many are
    due gets several files.
    """
    keyed = frontier.withColumn("due_hour", _due_hour(F.col("not_before")))
    order = ["state", "due_hour", "not_before", "url"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode(mode).partitionBy("state", "due_hour").parquet(path)


def due_scan(spark: SparkSession, path: str, now: datetime, n: int | None = None, schema: str = FRONTIER) -> DataFrame:
    """:func:`due_batch` of a frontier in the layout of :func:`write_frontier`: hours not due are not read.

    Without ``n`` nothing is sorted or shuffled: each file is in due order.  With
    ``n`` the rows of each hour are counted first (from file footers), and no hour is
    read beyond the one that completes ``n``.  Other columns of the frontier are read
    if ``schema`` names them.
    """
    stored = spark.read.schema(f"{schema}, state string, due_hour long").parquet(path)
    hour = spark.range(1).select(_due_hour(F.lit(now))).first()[0]
    pending = stored.filter((F.col("state") == "pending") & (F.col("due_hour") <= hour))
    if n is not None:
        past = pending.filter(F.col("due_hour") < hour).groupBy("due_hour").count().orderBy("due_hour")
        total = 0
        for row in past.toLocalIterator():
            total += row["count"]
            if total >= n:
                pending = pending.filter(F.col("due_hour") <= row["due_hour"])
                break
    due = pending.filter(F.col("not_before") <= F.lit(now)).drop("due_hour")
    return due if n is None else due.orderBy("not_before", "url").limit(n)


def retry_schedule(
    log: DataFrame, delay: str = RETRY_DELAY, max_attempts: int | None = None
) -> DataFrame:
    """Frontier rows for failed requests, due ``delay`` after the failure."""
    failed = log.filter(is_retry(F.col("status")))
    attempt = F.col("attempt") if "attempt" in log.columns else F.lit(0)
    again = failed.select(
        "url",
        "tag",
        "depth",
        (F.col("ts") + F.expr(f"INTERVAL {delay}")).alias("not_before"),
        F.lit("pending").alias("state"),
        (attempt + 1).alias("attempt"),
    )
    return again if max_attempts is None else again.filter(F.col("attempt") < max_attempts)


def requeue_active(frontier: DataFrame) -> DataFrame:
    """Rows in flight when the last run ended become pending, due as before."""
    return frontier.withColumn(
        "state", F.when(F.col("state") == "active", "pending").otherwise(F.col("state"))
    )


def backlog(frontier: DataFrame) -> DataFrame:
    """Rows per state; a walk is busy while any row is active."""
    return frontier.groupBy("state").agg(F.count("*").alias("n"))


def page_corpus(pages: DataFrame) -> DataFrame:
    """Captured pages as successful HTML responses."""
    return pages.select(
        "page_id",
        "url",
        F.lit(200).alias("status"),
        F.lit("").alias("location"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"),
    )


def unique_corpus(corpus: DataFrame, order_by: str) -> DataFrame:
    """The corpus keyed by normal URL, the least ``order_by`` where several share one.

    The choice is made on two narrow columns; bodies never pass through an
    aggregation.  ``order_by`` must differ between rows of the same URL.
    """
    keyed = with_normalized_url(corpus).filter(F.col("url").isNotNull())
    chosen = keyed.groupBy("url").agg(F.min(order_by).alias(order_by))
    return keyed.join(chosen, ["url", order_by], "left_semi")


def lookup_responses(frontier: DataFrame, corpus: DataFrame) -> DataFrame:
    """Frontier rows with their response; an URL not captured has no status."""
    new = [c for c in corpus.columns if c == "url" or c not in frontier.columns]
    found = frontier.join(corpus.select(*new), "url", "left")
    return found.withColumn("outcome", outcome(F.col("status"), F.col("location")))

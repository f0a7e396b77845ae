"""What becomes of a response: retried, dropped, followed, saved.

A fetch log has one row per response: ``ts, url, tag, depth, status, error,
location, content_type, body``.  A missing status is a transport error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import with_resolved_url

Handler = Callable[[DataFrame], DataFrame]


def is_retry(status: Column) -> Column:
    """Temporary failures: transport errors, 429 and every 5xx."""
    return status.isNull() | (status == 429) | (status >= 500)


def is_redirect(status: Column, location: Column) -> Column:
    return F.coalesce(status.between(300, 399) & (location != ""), F.lit(False))


def needs_retry(log: DataFrame) -> DataFrame:
    return log.filter(is_retry(F.col("status")))


def successful(log: DataFrame) -> DataFrame:
    """Responses below 400 (redirects are responses too)."""
    return log.filter(F.col("status") < 400)


def redirect_edges(log: DataFrame) -> DataFrame:
    """``(src_url, url, tag, depth)`` of every redirect whose target parses.

    The target is one step deeper and keeps the tag of its source.
    """
    moved = log.filter(is_redirect(F.col("status"), F.col("location")))
    sources = moved.select("tag", (F.col("depth") + 1).alias("depth"), F.col("url").alias("src_url"), "location")
    edges = with_resolved_url(sources, "src_url", "location", "url")
    return edges.filter(F.col("url").isNotNull()).select("src_url", "url", "tag", "depth")


def outcome(status: Column, location: Column) -> Column:
    return (
        F.when(is_retry(status), "retry")
        .when(status >= 400, "dropped")
        .when(is_redirect(status, location), "saved+redirect")
        .otherwise("saved")
    )


def classify(log: DataFrame) -> DataFrame:
    """Add ``outcome``: retry, dropped, saved or saved+redirect."""
    return log.withColumn("outcome", outcome(F.col("status"), F.col("location")))


def handle(log: DataFrame, handler: Handler) -> DataFrame:
    """Outlinks ``(src_url, url, tag)`` a user handler makes of saved responses.

    ``handler`` takes the successful responses and returns their outlinks; an
    exception in it fails the job.
    """
    out = handler(successful(log))
    missing = {"src_url", "url", "tag"} - set(out.columns)
    if missing:
        raise ValueError(f"handler result lacks columns {sorted(missing)}")
    return out.select("src_url", "url", "tag")

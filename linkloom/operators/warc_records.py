"""Responses as WARC records: one request and one response record each."""

from __future__ import annotations

from http.client import responses as REASONS

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import PARSE
from linkloom.functions._let import chain_columns

# Content types of WARC record types.  Fixed values.
CONTENT_TYPES = {
    "warcinfo": "application/warc-fields",
    "response": "application/http; msgtype=response",
    "request": "application/http; msgtype=request",
    "metadata": "application/warc-fields",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
USER_AGENT = "linkloom/1.0"


def _text_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def content_type_of(warc_type: Column) -> Column:
    return F.coalesce(F.element_at(_text_map(CONTENT_TYPES), warc_type), F.lit(DEFAULT_CONTENT_TYPE))


def record_id(*parts: Column) -> Column:
    """A name derived from the content's identity, so a rerun task repeats it."""
    digest = F.md5(F.concat_ws("\n", *parts))
    groups = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _request_head(e: dict) -> Column:
    target = F.concat(
        F.when(e["path"] == "", F.lit("/")).otherwise(e["path"]),
        F.when(e["query"] != "", F.concat(F.lit("?"), e["query"])).otherwise(F.lit("")),
    )
    return F.concat(
        F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), e["host"],
        F.lit(f"\r\nUser-Agent: {USER_AGENT}\r\n\r\n"),
    )


def _response_head(columns: list[str]) -> Column:
    reason = F.element_at(_text_map({str(int(k)): v for k, v in REASONS.items()}), F.col("status").cast("string"))
    status_line = F.concat_ws(" ", F.lit("HTTP/1.1"), F.col("status").cast("string"), reason)
    if "headers" in columns:
        headers = F.col("headers")
    else:
        given = [("Content-Type", F.col("content_type"))]
        if "location" in columns:
            given.append(("Location", F.col("location")))
        headers = F.map_from_entries(
            F.filter(
                F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in given]),
                lambda h: F.coalesce(h["value"], F.lit("")) != "",
            )
        )
    lines = F.transform(
        F.array_sort(F.map_entries(headers)), lambda h: F.concat(h["key"], F.lit(": "), h["value"], F.lit("\r\n"))
    )
    return F.concat(status_line, F.lit("\r\n"), F.coalesce(F.array_join(lines, ""), F.lit("")), F.lit("\r\n"))


def to_warc_records(responses: DataFrame) -> DataFrame:
    """WARC records of saved responses (``url, ts, status, content_type, body``).

    Columns: ``record_id, warc_type, target_uri, date, warcinfo_id,
    content_type, content_length, payload``.  ``warcinfo_id`` stays empty: the
    writer fills in the one of the file a record lands in.
    """
    base, e = chain_columns(responses, PARSE, {"raw": F.col("url")}, "__w_")
    body = F.coalesce(F.col("body").cast("binary"), F.lit(b""))

    def record(kind: str, payload: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), payload.alias("payload"))

    records = base.select(
        "url",
        "ts",
        F.explode(
            F.array(
                record("request", F.encode(_request_head(e), "UTF-8")),
                record("response", F.concat(F.encode(_response_head(responses.columns), "UTF-8"), body)),
            )
        ).alias("r"),
    )
    return records.select(
        record_id(F.col("url"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("r.warc_type")).alias(
            "record_id"
        ),
        F.col("r.warc_type").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.col("ts").alias("date"),
        F.lit(None).cast("string").alias("warcinfo_id"),
        content_type_of(F.col("r.warc_type")).alias("content_type"),
        F.octet_length("r.payload").cast("long").alias("content_length"),
        F.col("r.payload").alias("payload"),
    )

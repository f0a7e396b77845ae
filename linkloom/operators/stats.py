"""Walk statistics over a fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: period of the running report
STATS_PERIOD = "10 seconds"


def body_bytes() -> Column:
    """Bytes read of one response: bodies of 4xx and 5xx are not read."""
    return F.when(F.col("status") < 400, F.octet_length("body").cast("long")).otherwise(F.lit(0).cast("long"))


def bytes_read(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum(body_bytes()), F.lit(0)).alias("bytes"))


def saved_count(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status") < 400).agg(F.count("*").alias("saved"))


def status_histogram(log: DataFrame) -> DataFrame:
    """Responses per status; transport errors have none and are not counted."""
    return log.filter(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("urls"))


def status_map(log: DataFrame) -> DataFrame:
    """The histogram as one ``map<status,count>``; one entry per distinct status."""
    entries = F.sort_array(F.collect_list(F.struct("status", "urls")))
    return status_histogram(log).agg(F.map_from_entries(entries).alias("states"))


def fetch_stats(log: DataFrame, elapsed: Column | None = None) -> DataFrame:
    """``urls, bytes, kb_per_s``; elapsed seconds default to the span of the log."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    seconds = span / F.lit(1e6) if elapsed is None else F.any_value(elapsed)
    totals = log.agg(
        F.count("status").alias("urls"),
        F.coalesce(F.sum(body_bytes()), F.lit(0)).alias("bytes"),
        seconds.alias("seconds"),
    )
    rate = F.when(F.col("seconds") > 0, F.col("bytes") / F.col("seconds") / 1000)
    return totals.select("urls", "bytes", rate.alias("kb_per_s"))


def stats_every(log: DataFrame, period: str = STATS_PERIOD, by_status: bool = False) -> DataFrame:
    """Running totals at the end of each period in which a response came.

    With ``by_status`` the totals run per status.  Rows are first summed per
    period.  The running sum is built from two windows: within a day, and over
    daily totals, so no task holds more than one day of periods.
    """
    group = ["status"] if by_status else []
    received = log.filter(F.col("status").isNotNull())
    periods = (
        received.groupBy(F.window("ts", period).end.alias("period_end"), *group)
        .agg(F.count("*").alias("urls"), F.sum(body_bytes()).alias("bytes"))
        .withColumn("day", F.to_date("period_end"))
    )
    within = Window.partitionBy(*group, "day").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    # 8,640 periods shrink to one row here
    days = periods.groupBy(*group, "day").agg(F.sum("urls").alias("day_urls"), F.sum("bytes").alias("day_bytes"))
    offsets = days.select(
        *group,
        "day",
        F.coalesce(F.sum("day_urls").over(before), F.lit(0)).alias("urls_before"),
        F.coalesce(F.sum("day_bytes").over(before), F.lit(0)).alias("bytes_before"),
    )
    running = periods.select(
        *group,
        "day",
        "period_end",
        F.sum("urls").over(within).alias("urls_within"),
        F.sum("bytes").over(within).alias("bytes_within"),
    )
    return running.join(offsets, [*group, "day"]).select(
        "period_end",
        *group,
        (F.col("urls_within") + F.col("urls_before")).alias("urls"),
        (F.col("bytes_within") + F.col("bytes_before")).alias("bytes"),
    )


def stats_report(log: DataFrame, period: str = STATS_PERIOD) -> DataFrame:
    """:func:`stats_every` with what each period brought, and the rate since the first response.

    ``period_urls, period_bytes`` are differences of the running totals; ``kb_per_s``
    is the bytes so far over the seconds from the first response to the period's end, over 1000.
    """
    totals = stats_every(log, period).withColumn("day", F.to_date("period_end"))
    # neighbours within a day, and each day's last totals for the next one's first period
    within = Window.partitionBy("day").orderBy("period_end")
    closing = totals.groupBy("day").agg(F.max("urls").alias("day_urls"), F.max("bytes").alias("day_bytes"))
    days = Window.orderBy("day")
    before = closing.select("day", *[F.coalesce(F.lag(f"day_{c}").over(days), F.lit(0)).alias(f"{c}_before") for c in ("urls", "bytes")])
    first = log.filter(F.col("status").isNotNull()).agg(F.min("ts")).scalar()
    seconds = (F.unix_micros("period_end") - F.unix_micros(first)) / F.lit(1e6)
    return (
        totals.withColumns({f"last_{c}": F.lag(c).over(within) for c in ("urls", "bytes")})
        .join(before, "day")
        .select(
            "period_end",
            "urls",
            "bytes",
            *[(F.col(c) - F.coalesce(f"last_{c}", f"{c}_before")).alias(f"period_{c}") for c in ("urls", "bytes")],
            F.when(seconds > 0, F.col("bytes") / seconds / 1000).alias("kb_per_s"),
        )
    )

"""The frontier, statistics, retries and archive writing as streams.

State grows with the number of distinct keys, so run these with the RocksDB
state store (:data:`RECOMMENDED`).  Restarting is Structured Streaming's own:
give the query a ``checkpointLocation``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructField, StructType

from linkloom.operators.frontier import RETRY_DELAY, candidates_in_scope
from linkloom.operators.responses import is_retry, successful
from linkloom.operators.scope import Scope
from linkloom.operators.stats import STATS_PERIOD, body_bytes
from linkloom.operators.warc_records import to_warc_records
from linkloom.sources.warc import register

#: parts in which failures wait; no more tasks than these share the work
RETRY_SHARDS = 64
#: failures that are put away together
PIECE_ROWS = 5_000

#: session settings the streaming operators are meant to run with
RECOMMENDED = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_frontier(
    urls: DataFrame, scope: Scope, ttl: str | None = None, time_column: str = "ts"
) -> DataFrame:
    """New frontier rows of a stream of candidates, each URL once.

    Without ``ttl`` every URL is remembered for ever.  With it, a URL is
    remembered for at least ``ttl`` of event time (``time_column``), and counts
    as new once its state has gone.
    """
    if ttl is None:
        return candidates_in_scope(urls, scope).dropDuplicates(["url"])
    timed = candidates_in_scope(urls.withWatermark(time_column, ttl), scope)
    return timed.dropDuplicatesWithinWatermark(["url"])


def stream_stats(log: DataFrame) -> DataFrame:
    """Running responses and bytes per status (output mode ``complete``)."""
    received = log.filter(F.col("status").isNotNull())
    return received.groupBy("status").agg(F.count("*").alias("urls"), F.sum(body_bytes()).alias("bytes"))


def report_stats(log: DataFrame, name: str, checkpoint: str, period: str = STATS_PERIOD) -> StreamingQuery:
    """Keep :func:`stream_stats` as the in-memory table ``name``, renewed each period."""
    return (
        stream_stats(log)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=period)
        .start()
    )


class _Waiting(StatefulProcessor):
    """Failed requests of one shard, in pieces sorted by due time, with one timer: the end of the first second due.

    Pieces are Arrow streams of at most ``PIECE_ROWS`` rows, so a batch costs a shard a few calls to its state,
    however many seconds its rows are due in.
    """

    def __init__(self, columns: list[str], schema: StructType):
        self.columns, self.schema = columns, schema

    def init(self, handle) -> None:
        self.handle, self.arrow = handle, to_arrow_schema(self.schema)
        self.pieces = handle.getMapState("pieces", "piece long", "rows binary")
        #: piece numbers and the second in which each piece's first row is due
        self.index = handle.getValueState("index", "pieces array<long>, seconds array<long>")

    def _known(self) -> dict[int, int]:
        return dict(zip(*self.index.get())) if self.index.exists() else {}

    def _keep(self, frame: pd.DataFrame, known: dict[int, int]) -> None:
        frame = frame.sort_values("due", kind="stable")
        for at in range(0, len(frame), PIECE_ROWS):
            part = frame.iloc[at : at + PIECE_ROWS]
            piece = max(known, default=-1) + 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.arrow) as writer:
                writer.write_batch(pa.RecordBatch.from_pandas(part, self.arrow, preserve_index=False))
            self.pieces.updateValue((piece,), (sink.getvalue().to_pybytes(),))
            known[piece] = int(part["due"].iloc[0]) // 1_000_000

    def _remember(self, known: dict[int, int], timer: int | None) -> None:
        """Put the index away; the shard's timer, now at the end of second ``timer``, moves to the first one due."""
        if known:
            self.index.update((list(known), list(known.values())))
        else:
            self.index.clear()
        first = min(known.values(), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer((timer + 1) * 1000)
            if first is not None:
                self.handle.registerTimer((first + 1) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        timer = min(known.values(), default=None)
        for frame in rows:
            frame = frame[self.columns]
            late = (frame["due"] // 1_000_000 + 1) * 1000 <= clock
            if late.any():
                yield frame[late]
            self._keep(frame[~late], known)
        self._remember(known, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        waiting: list[pd.DataFrame] = []
        for piece, second in list(known.items()):
            if (second + 1) * 1000 > clock:
                continue
            frame = pa.ipc.open_stream(self.pieces.getValue((piece,))[0]).read_pandas()
            self.pieces.removeKey((piece,))
            del known[piece]
            due = (frame["due"] // 1_000_000 + 1) * 1000 <= clock
            yield frame[due]
            if not due.all():
                waiting.append(frame[~due])
            if sum(map(len, waiting)) >= PIECE_ROWS:
                self._keep(pd.concat(waiting), known)
                waiting.clear()
        if waiting:
            self._keep(pd.concat(waiting), known)
        # the timer that brought this here is gone
        self._remember(known, None)

    def close(self) -> None:
        pass


def stream_retries(log: DataFrame, delay: str = RETRY_DELAY, lateness: str = "0 seconds", shards: int = RETRY_SHARDS) -> DataFrame:
    """Failed requests, each emitted once the log's clock has passed the second it is due in.

    Requests wait in ``shards`` equal parts, in pieces in due order; each part has one
    event-time timer, for the first second due; no URL and no burst meets in one of them.  A failure that
    arrives when it is already due, however late, is emitted with its micro-batch:
    nothing is dropped.  The clock is the largest ``ts`` of earlier batches, less
    ``lateness``; responses that succeed move it as well.  (Output mode
    ``append``; needs the RocksDB state store.)
    """
    clocked = log.withWatermark("ts", lateness)
    # reading the clock's column keeps the test above the clock, and no column of
    # the clock itself goes on, so rows behind it are not taken for stale ones
    failed = clocked.filter(F.when(F.col("ts").isNotNull(), is_retry(F.col("status"))))
    attempt = F.col("attempt") if "attempt" in log.columns else F.lit(0)
    due = F.unix_micros(F.col("ts") + F.expr(f"INTERVAL {delay}"))
    rows = failed.select("url", "tag", "depth", due.alias("due"), (attempt + 1).cast("int").alias("attempt"))
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema])
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("url", "due"), F.lit(shards)))
    released = keyed.groupBy("shard").transformWithStateInPandas(
        _Waiting(rows.columns, schema), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )
    return released.select(
        "url", "tag", "depth", F.timestamp_micros("due").alias("not_before"), F.lit("pending").alias("state"), "attempt"
    )


def stream_to_warc(
    log: DataFrame, path: str, checkpoint: str, max_bytes: int = 0, trigger: dict | None = None, tasks: int | None = None
) -> StreamingQuery:
    """Archive saved responses as they arrive, one folder per micro-batch.

    A batch is one job of the archive writer: it counts once its manifest is
    there, and a batch that is replayed after that writes nothing.  One that comes
    in fewer partitions than ``tasks`` (as many as there are cores, if not given) is
    dealt over that many, each with files of its own: bytes say little of the records
    in a source's file, and compressing them is the work.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        register(batch.sparkSession)
        wanted = tasks or batch.sparkSession.sparkContext.defaultParallelism
        if batch.rdd.getNumPartitions() < wanted:
            batch = batch.repartition(wanted)
        records = to_warc_records(batch)
        folder = f"{path}/batch={batch_id:010d}"
        options = {"maxBytes": max_bytes, "jobId": f"batch-{batch_id}"}
        records.write.format("warc").options(**options).mode("append").save(folder)

    writer = successful(log).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

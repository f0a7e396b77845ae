"""Token ids as Parquet list columns that allow selective reading.

``ids`` is a list column whose chunks are dictionary encoded (a row group's ids
are few distinct numbers, so they become bit-packed) or delta encoded; row groups
and pages have a set size, and the writer leaves page indexes, so a reader that
wants some documents, or only their lengths, skips the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from linkloom.llm.common import written
from linkloom.llm.tokens import encoder
from linkloom.plans.storage import fresh_dir

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Write the ids of all ``docs`` in ascending ``doc_id`` order below ``path``.

    Each file holds a range of ids, in order, and says in ``part`` which one;
    ``start_in_part`` counts the ids before a document in its file.  Null ids come
    first, rows that repeat an id follow each other, a null or empty text is one
    ``end_id``.  Texts are dealt out before they are encoded, so the sample that
    finds the ranges costs no tokenizing.  ``encoding`` is ``dictionary`` or ``delta``.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, bounds = encoder(tokenizer).encode(batch.column("text"), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(batch.num_rows, part, np.int32)),
                    pa.array(bounds[:-1] + before),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            before += int(bounds[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    (
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the files: ``start`` counts the ids of all documents before.

    Selecting no ``ids`` reads none: starts come from the lengths, of which each
    file's total is one row.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    # a row per file; written, so that its size is known when the join is planned
    return files.join(written(offsets, "file-offsets"), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    bounds = ids.offsets.to_numpy()
    raw = memoryview(ids.values.to_numpy().astype("<u4")).cast("B")
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, **options) -> DataFrame:
    """Write ``docs`` to a folder of the shared one and describe what is read back, per document.

    Returns ``doc_id, start, n_tokens, ids_crc32``; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = fresh_dir(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id, **options)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))

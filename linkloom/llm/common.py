"""What the training-data operators share: session settings, text forms, written tables."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import session
from linkloom.plans.storage import fresh_dir

#: Arrow batches are cut by bytes, so that long texts cannot fill a Python worker
BATCH_BYTES = 4 << 20

WHITESPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """The library's session settings, and bounded Arrow batches."""
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, sizes are known after it.

    ``compact`` is for tables as large as the input: sorted numbers become small differences.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    options = {"compression": "zstd", "parquet.writer.version": "v2"} if compact else {}
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_slices(batch: pa.RecordBatch, texts: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``texts`` columns hold some ``limit`` bytes, a row with more alone: what is made of them is bounded."""
    sizes = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts]
    ends = np.cumsum(sum(sizes))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """Return freed memory to the system: a worker that is done keeps it beside the next operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; texts that are all ASCII take the faster built-in."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def text_key(c: Column) -> Column:
    """A 64-bit hash that tells apart the texts of rows which share an id."""
    return F.xxhash64(F.coalesce(c, F.lit("")))

"""Whitening of embeddings by a covariance weighted with multiplicities.

Vectors become whole numbers, equal ones one row with a count.  Sums of the distinct
vectors, weighted by counts (or by one), give the mean; a weighted centred product
of matrices in each partition gives the covariance, whose entries Spark adds up.
Each distinct vector is whitened once and joined back to the rows that hold it.
Only matrices of the vectors' dimensions reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written

#: whole numbers end here, so that doubles hold them exactly
LARGEST = 1 << 53
LOW = 26


def whole_numbers(c: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """``floor(scale * entry) + shift`` of an array's entries (as doubles), held within +-2^53."""

    def whole(x: Column) -> Column:
        bounded = F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
        return F.floor(bounded).cast("long") + shift

    return F.transform(c, whole)


def usable(c: Column) -> Column:
    """True for arrays with entries that are all finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added(parts: DataFrame) -> dict[tuple[int, int], float]:
    """Entries ``i, j, value`` added up by Spark; as many as a matrix has reach the driver."""
    return {(r[0], r[1]): r[2] for r in parts.groupBy("i", "j").agg(F.sum("value")).collect()}


def weighted_mean(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """The sum of the weights, and the exact sums of ``weight * x`` by dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # high and low bits apart: neither sum can leave 64 bits
        total, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            w = batch.column("weight").to_numpy()
            x = _matrix(batch.column("x"), width)
            total += int(w.sum())
            high += w @ (x >> LOW)
            low += w @ (x & ((1 << LOW) - 1))
        at = np.arange(width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(([-1], at, at)), pa.int32()),
                pa.array(np.concatenate(([0], np.zeros(width, int), np.ones(width, int))), pa.int32()),
                pa.array(np.concatenate(([total], low, high)), pa.int64()),
            ],
            ["i", "j", "value"],
        )

    got = _added(vectors.select("x", "weight").mapInArrow(sums, "i int, j int, value long").withColumn("value", F.col("value").cast("decimal(38,0)")))
    return int(got.get((-1, 0), 0)), [(int(got.get((i, 1), 0)) << LOW) + int(got.get((i, 0), 0)) for i in range(width)]


def weighted_covariance(vectors: DataFrame, column: str, centre: np.ndarray, total: int) -> np.ndarray:
    """Covariance of ``column`` around ``centre``: each partition's weighted product, added up by Spark."""
    width = len(centre)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(column), width) - centre
            sums += (x * batch.column("weight").to_numpy()[:, None]).T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], ["i", "j", "value"]
        )

    got = _added(vectors.select(column, "weight").mapInArrow(product, "i int, j int, value double"))
    upper = np.zeros((width, width))
    for (i, j), value in got.items():
        upper[i, j] = upper[j, i] = value
    return upper / max(total, 1)


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns.

    Values that cannot be told from zero are left out; of either sign of a vector
    the one whose largest entry is positive is taken.
    """
    values, vectors = np.linalg.eigh(covariance)
    least = len(values) * np.finfo(float).eps * max(values[-1], 0.0) if len(values) else 0.0
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > least]
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0) if len(order) else np.zeros(0, int)
    return values, vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: as 64-bit numbers if they fit with room, else as Python's."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    most = max((max(abs(n * low - s), abs(n * high - s)) for s in sums), default=0)
    if max(most, n * max(abs(low), abs(high)), max(map(abs, sums), default=0)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(v: np.ndarray) -> pa.Array:
    """Exact sums of the squares of each row; null where 64 bits do not hold it."""
    if v.dtype != object:
        most = int(np.abs(v).max()) if v.size else 0
        if most * most * v.shape[1] < 1 << 63:
            return pa.array((v * v).sum(axis=1), pa.int64())
        v = v.astype(object)
    return pa.array([s if s < 1 << 63 else None for s in (int((row * row).sum()) for row in v)], pa.int64())


def whiten(
    embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 8, weights: str = "counts"
) -> DataFrame:
    """Whitened coordinates of every usable row on the largest principal components.

    Entries become whole numbers (:func:`whole_numbers`); equal vectors are fitted
    as one row of weight ``counts`` (how often they occur) or ``one``.  Returns a
    row per input row and component, ``vec_id`` (the id column), ``component`` from 1, ``n`` (the sum of
    weights), ``deviation`` (sum over dimensions of ``(n*x - S)^2``, null where it
    exceeds 64 bits), ``whitened``, ``explained`` and ``identity_error``.

    Rows whose vector is null or empty or holds a null or non-finite entry have no
    result, nor do vectors of another length than most have (the longer, if as many).
    Components whose eigenvalue is zero are left out, so a table of equal vectors,
    or an empty one, gives no rows.  Rows that repeat an id or a vector, and null ids, are
    kept as they are; other columns are ignored.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"unknown weights {weights!r}")
    rows = embeddings.where(usable(F.col(column))).select(
        F.col(id_column).alias("vec_id"), whole_numbers(F.col(column)).alias("x")
    )
    # a digest of the vector's text is its key; vectors themselves move once, reduced in each task
    key = F.unhex(F.sha2(F.array_join("x", ","), 256))
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0]["width"] if lengths else 1
    rows = rows.where(F.size("x") == width)
    weight = F.count(F.lit(1)) if weights == "counts" else F.first(F.lit(1).cast("long"))
    vectors = written(rows.groupBy("x").agg(weight.alias("weight")).select(key.alias("key"), "x", "weight"), "vectors")

    n, sums = weighted_mean(vectors, width)
    mean = np.array([float(Fraction(s, n)) if n else 0.0 for s in sums])
    covariance = weighted_covariance(vectors, "x", mean, n)
    values, axes = principal(covariance, components)
    count = len(values)
    shared = embeddings.sparkSession.sparkContext.broadcast((n, sums, axes / np.sqrt(values)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, onto = shared.value
        for batch in batches:
            off = _differences(_matrix(batch.column("x"), width), n, sums)
            z = (off.astype(float) / n) @ onto
            ends = np.arange(len(z) + 1, dtype=np.int32) * count
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("weight"), _squares(off), pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))],
                ["key", "weight", "deviation", "z"],
            )

    schema = "key binary, weight long, deviation long, z array<double>"
    done = written(vectors.mapInArrow(project, schema), "whitened")
    error = identity_error(done, count, n)
    trace = float(np.trace(covariance))
    explained = F.array(*[F.lit(float(v) / trace) for v in values]).cast("array<double>")
    coordinate = F.posexplode(F.arrays_zip(F.col("z").alias("whitened"), explained.alias("explained"))).alias("at", "c")
    return (
        rows.select("vec_id", key.alias("key"))
        .join(done.select("key", "deviation", "z"), "key")
        .select("vec_id", "deviation", coordinate)
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            F.col("c.whitened").alias("whitened"),
            F.col("c.explained").alias("explained"),
            F.lit(float(error)).alias("identity_error"),
        )
    )


def identity_error(whitened: DataFrame, count: int, total: int) -> float:
    """Largest absolute entry of the covariance of ``z`` minus the identity (0 without components)."""
    if not count:
        return 0.0
    sums = [F.sum(F.col("weight") * F.get("z", F.lit(k))).alias(str(k)) for k in range(count)]
    mean = np.array(whitened.agg(*sums).first(), float) / total
    return float(np.abs(weighted_covariance(whitened, "z", mean, total) - np.eye(count)).max())


def whitened_vectors(result: DataFrame) -> DataFrame:
    """``vec_id, vector`` from rows of :func:`whiten`, components in order; ids must be unique."""
    parts = F.sort_array(F.collect_list(F.struct("component", F.col("whitened").alias("value"))))
    return result.groupBy("vec_id").agg(F.transform(parts, lambda p: p["value"]).alias("vector"))


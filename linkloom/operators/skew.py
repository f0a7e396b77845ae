"""Equi-joins whose big side may have a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    big: DataFrame, lookup: DataFrame, on: list[str], how: str, spread_by: list[str], salts: int
) -> DataFrame:
    """Join ``big`` to ``lookup`` with every key split over ``salts`` partitions.

    ``lookup`` must be the smaller side, since its rows are repeated once per
    salt; ``spread_by`` are columns of ``big`` that differ within a key.  With
    ``salts=1`` this is a plain join, left to adaptive skew handling.
    """
    if salts <= 1:
        return big.join(lookup, on, how)
    big = big.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    lookup = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(lookup, [*on, "__salt"], how).drop("__salt")

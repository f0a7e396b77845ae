"""Seed lists, URL files and pattern files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.ignore_list import bundled
from linkloom.functions.markup import TAG_PRIMARY
from linkloom.functions.regex_match import re2_error, re2_errors
from linkloom.functions.urls import url_valid

#: session setting naming a folder of pattern files used instead of the bundled list
IGNORE_PATH_SETTING = "spark.linkloom.ignorePatterns"


def _as_seeds(urls: DataFrame) -> DataFrame:
    return urls.select("url", F.lit(TAG_PRIMARY).alias("tag"), F.lit(0).alias("depth"))


def seeds_df(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    """Seeds at depth 0; a ``ValueError`` names every URL that does not parse."""
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    bad = [r["url"] for r in frame.filter(~url_valid(F.col("url"))).collect()]
    if bad:
        raise ValueError(f"not a URL: {bad}")
    return _as_seeds(frame)


def checked_urls(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """Seeds from a frame with one URL per row in ``value`` (batch or stream).

    ``failfast`` fails the job on the first bad line, ``drop`` leaves it out.
    """
    if mode not in ("failfast", "drop"):
        raise ValueError(f"unknown mode {mode!r}")
    url = F.col("value")
    if mode == "drop":
        return _as_seeds(lines.filter(url_valid(url)).select(url.alias("url")))
    complaint = F.raise_error(F.concat(F.lit("not a URL: "), url)).cast("string")
    return _as_seeds(lines.select(F.when(url_valid(url), url).otherwise(complaint).alias("url")))


def read_url_list(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """Seeds from text files holding one URL per line."""
    return checked_urls(spark.read.text(path), mode)


def read_exclude_patterns(spark: SparkSession, *paths: str) -> list[str]:
    """Patterns from text files, one per line; blank lines are skipped.

    A pattern RE2 does not compile raises, with its file and line.
    """
    patterns: list[str] = []
    for path in paths:
        # one file of patterns is one row, so line numbers survive
        for row in spark.read.text(path, wholetext=True).select("value", "_metadata.file_name").collect():
            for number, line in enumerate(row["value"].split("\n"), start=1):
                if not line.strip():
                    continue
                error = re2_error(line)
                if error:
                    raise ValueError(f"{row['file_name']}, line {number}: {error}")
                patterns.append(line)
    return patterns


def read_ignore_json(spark: SparkSession, path: str) -> DataFrame:
    """``(family, pattern, error)`` from JSON files with a ``patterns`` array.

    The family is the file's name.  ``error`` is set for patterns RE2 cannot
    use (back-references, look-around); filter on it to keep the usable ones.
    """
    files = spark.read.schema("patterns array<string>").option("multiLine", True).json(path)
    listed = files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("family"),
        F.explode("patterns").alias("pattern"),
    )
    return listed.withColumn("error", re2_errors(F.col("pattern")))


def default_ignores(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(family, pattern)`` of the default ignore list, each pattern once.

    ``path`` (or the session setting :data:`IGNORE_PATH_SETTING`) names a folder
    of JSON pattern files to use; otherwise the bundled families are given.
    """
    path = path or spark.conf.get(IGNORE_PATH_SETTING, None)
    if path is None:
        return spark.createDataFrame(bundled(), "family string, pattern string")
    usable = read_ignore_json(spark, path).filter(F.col("error").isNull())
    return usable.groupBy("pattern").agg(F.min("family").alias("family")).select("family", "pattern")

"""Exact duplicates: groups of a 128-bit content hash, told apart by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import ascii_lower, written


def exact_groups(docs: DataFrame) -> DataFrame:
    """The group of equal texts of every document.

    Texts are equal if they are identical after lower-casing A-Z; null counts as
    empty.  The aggregation's key is the content hash together with the text, so
    texts whose hashes collide stay apart; copies meet in each task before the
    shuffle, so a group of any size sends one row per task.  Group rows hold no
    text, and a group of many rows is split by the adaptive join.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input
    row.  The largest ``doc_id`` of a group stays.  Rows that repeat an id are one
    document and share its flags; a null id stays only if its group has no other.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    digest = F.unhex(F.md5("text")).alias("hash128"), F.unhex(F.sha2("text", 256)).alias("sha")
    groups = (
        rows.select("doc_id", "text", digest[0])
        .groupBy("hash128", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("hash128", digest[1], "keep_id", "group_size")
    )
    groups = written(groups, "copies")
    narrow = rows.select("doc_id", *digest)
    return (
        narrow.join(groups, ["hash128", "sha"], "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows with a null id are kept.  Of rows that repeat an id, those go whose own text another id has.
    """
    gone = exact_groups(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__text"))
    keyed = docs.withColumn("__key", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    same = (F.col("doc_id") == F.col("__gone")) & (F.col("__key") == F.col("__text"))
    return keyed.join(gone.distinct(), same, "left_anti").select(*docs.columns)

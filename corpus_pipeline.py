"""A training corpus from raw documents: stages that each apply one operator.

A stage takes what its predecessor kept and returns the columns of ``documents``;
the last one returns packed pieces.  ``run`` writes each stage's result to the
shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontamination, language, line_templates, near_dups, packing
from linkloom.llm.common import id_remainder, prepare, table, written
from linkloom.llm.tokens import default_tokenizer

#: a text is rejected if its language's n-grams are a smaller share than this
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names; null, letterless and foreign texts go."""
    prepare(spark)
    filters = language.learn_filters(docs.where(id_remainder(F.col("doc_id"), 4) != 2))
    judged = language.predict(docs.select("*"), filters)
    return judged.where((F.col("lang_pred") != language.NONE) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents freed of lines and passages that recur in earlier ones; those of which nothing is left go."""
    prepare(spark)
    cleaned = line_templates.drop_recurring_lines(docs)
    # blank lines between dropped ones are no text either
    cleaned = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    sizes = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(sizes).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    prepare(spark)
    return near_dups.drop_near_duplicates(docs).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    benchmark = table(prepare(spark), sf_dir, "benchmark")
    return decontamination.decontaminate(docs, benchmark, n=13, share=20, action="drop").select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of 4096 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, default_tokenizer(), capacity=4096, end_id=1)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_recurring_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("packing", packed_sequences),
]

#: tokens, signatures and the language filters are beyond SQL; tests hold the rows against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

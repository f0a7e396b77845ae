"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import alignment, decontamination, exact_dedup, language, line_templates, main_text, near_dups, packing, pii, token_files, toxicity, url_rules, whitening
from linkloom.llm.common import prepare, table
from linkloom.llm.tokens import default_tokenizer, public_vocabulary


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(prepare(spark), sf_dir, "pages"))


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(prepare(spark), sf_dir, "documents"), percent=75)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(prepare(spark), sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return packing.pack_documents(docs, default_tokenizer(), capacity=4096, end_id=1)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return token_files.round_trip(docs, default_tokenizer(), end_id=1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(prepare(spark), sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(prepare(spark), sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return alignment.alignment_digest(docs, public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(prepare(spark), sf_dir, "pages"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(prepare(spark), sf_dir, "embeddings"), components=8)


QUERIES = {
    "op1_url_rules": op1_url_rules,
    "op2_minhash_near_dups": op2_minhash_near_dups,
    "op3_pii": op3_pii,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_main_text": op12_main_text,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op7_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), item_windows AS (
            SELECT item_id, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), sizes AS (
            SELECT DISTINCT n FROM item_windows
        ), doc_windows AS (
            SELECT doc_id, n, i, w[i:i + n - 1] AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
        ), hits AS (
            SELECT doc_id, item_id, n, i FROM doc_windows JOIN item_windows USING (n, win)
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        ), covered AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit
            FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op9_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), g AS (
            SELECT doc_id, text, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256 FROM g
    """,
}

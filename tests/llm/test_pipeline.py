"""The corpus pipeline stage by stage against plain Python."""

import pytest
from brute import contamination, near_components

import corpus_pipeline
from linkloom.llm.common import prepare, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def test_columns(results):
    assert all(r.columns == results[0].columns for r in results[:-1])


def test_near_dedup_keeps_one_of_each_component(results):
    texts = {r.doc_id: r.text for r in results[2].collect()}
    kept = {d for d, (_, c) in near_components(texts.items()).items() if c == d}
    assert {r.doc_id for r in results[3].collect()} == kept


def test_decontamination_drops_what_the_benchmark_hits(spark, results):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = {r.doc_id: contamination(r.text, items) for r in results[3].collect()}
    kept = {d for d, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in results[4].collect()} == kept


def test_packing_has_every_document(results):
    assert {r.doc_id for r in results[5].collect()} == {r.doc_id for r in results[4].collect()}


def test_odd_rows_and_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prepare(spark)
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (2, "", "en", "", 0), (None, "hello there you", "en", None, 1), (4, "hello there all", "en", "s", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "stage")
        assert docs.count() <= len(rows)


def test_shared_notice_goes_from_short_documents(spark):
    notice = "All rights are reserved by the owners\nNo part of this may be copied"
    rows = [(i, f"{notice}\n{own} alone", "en", "s", 1) for i, own in enumerate(("first text", "second text", "third text", "fourth text"))]
    rows.append((9, notice, "en", "s", 1))
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_recurring_lines(spark, docs, SF).collect()}
    assert got == {0: rows[0][1], 1: "second text alone", 2: "third text alone", 3: "fourth text alone"}


def test_stages_run_python_once_a_row(spark):
    """A filter on what Arrow functions return must not plan them twice: each takes Python workers of its own."""
    rows = [(i, f"one line of some words that recurs here\nalone {i}", "en", "s", 1) for i in range(4)]
    docs = written(prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    for stage in (corpus_pipeline.known_language, corpus_pipeline.without_recurring_lines):
        plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_language_stage_sends_no_list_through_python_workers(spark, monkeypatch):
    rows = [(1, "hello there you", "en", "s", 1), (2, "guten tag zusammen", "de", "s", 1)]
    docs = written(prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    sent = []
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **b: sent.append(a))
    assert corpus_pipeline.known_language(spark, docs, SF).count() <= 2
    assert not sent

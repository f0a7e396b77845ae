"""The training-data operators against plain Python, on odd rows and on the smallest tables."""

import glob
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import base_spans, contamination, lower, near_components
from pyspark.sql import functions as F

from linkloom.llm import (
    decontamination,
    exact_dedup,
    language,
    line_templates,
    near_dups,
    packing,
    pii,
    token_files,
    toxicity,
    url_rules,
)
from linkloom.llm.common import prepare
from linkloom.llm.components import components
from linkloom.llm.queries import ORACLE, QUERIES
from linkloom.llm import tokens
from linkloom.llm.tokens import default_tokenizer, encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, kept string, score string, length string, n_lines string"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(20000))
TEXTS = [
    None, "", "  \n\t ", "one", "Éa b", "the same text of some words here", "THE same text of some words here",
    LONG, LONG + " tail", "a@b.c%x@d.e, 1.2.3.4 999.1.1.1 +1 (504) 555-2652 4539 1488 0343 6467", "1 " * 4000, "x" * 50000,
    "Foo, bar. <|endoftext|>, don't THE'S. ΟΔΟΣ. a.b,c. ǅ", "  lead\x0b\x0ctrail  nb s  é́ x.",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "k", "s", "l", "n") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id", "en", "", "", "", ""), (None, None, None, "", "", "", "")]
    return prepare(spark).createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return prepare(spark).createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return prepare(spark).read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


def test_exact_groups(odd, none):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(odd).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i, hashlib.sha256(lower(text).encode()).hexdigest()]
        same = [k for k, t in enumerate(TEXTS) if lower(t) == lower(text)]
        assert (r.keep_id, r.kept) == (max(same), i == max(same))
    assert rows[5, hashlib.sha256(lower(TEXTS[5]).encode()).hexdigest()].group_size == 3
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(odd).where("doc_id is not null").count() == 12


def test_encoder_is_the_tokenizer():
    e = encoder(default_tokenizer())
    ids, bounds = e.encode(pa.array(TEXTS), 1)
    for i, text in enumerate(TEXTS):
        assert list(ids[bounds[i] : bounds[i + 1]]) == [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(odd, none, encoding):
    rows = token_files.round_trip(odd.where("doc_id is not null"), default_tokenizer(), encoding=encoding).collect()
    tokenizer, start = encoder(default_tokenizer()).tokenizer, 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = [*tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted(r.doc_id for r in rows)
    assert len(rows) == len(TEXTS) + 1
    assert token_files.round_trip(none, default_tokenizer()).count() == 0


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(odd, none):
    rows = packing.pack_documents(odd, default_tokenizer(), with_ids=True).cache()
    found = rows.collect()
    assert check_packing(found, 4096) == -(-sum(r.length for r in found) // 4096)
    whole, _ = encoder(default_tokenizer()).encode(pa.array([LONG]), 1)
    pieces = sorted((r for r in found if r.doc_id == 7), key=lambda r: r.piece)
    assert [r.length for r in pieces[:-1]] == [4096] * (len(pieces) - 1)
    assert [i for r in pieces for i in r.ids] == list(whole)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    assert {r.n_tokens for r in packing.sequences(rows).collect() if r.n_tokens != len(r.ids)} == set()
    assert packing.pack_documents(none, default_tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_fills_every_slot_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.choice([1, 2, 3, 50, 1000]) for _ in range(rng.randint(1, 40))}
    plan = packing.plan_packing(counts, 100)
    bins = {}
    for length, runs in plan.runs.items():
        assert sum(r.count for r in runs) == counts[length]
        for r in runs:
            for k in range(r.count):
                bins.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * length, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100 and sum(3 * x > 100 for _, x in parts) <= 2
    assert len(bins) == plan.sequences
    total = sum(length * n for length, n in counts.items())
    pairs = sum(n for length, n in counts.items() if 2 * length > 100)
    assert plan.sequences <= 1.23 * max(pairs, -(-total // 100)) + 1


def test_pii(odd, none, documents):
    for docs in (odd, documents):
        texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
        for r in pii.personal_data(docs).where("doc_id is not null").collect():
            spans = base_spans(texts[r.doc_id])
            listed = [f"{k}:{a}:{b}" for k, a, b in spans]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
            assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
            assert set(listed) <= set(r.spans.split(",")) | {""}
    assert pii.personal_data(none).count() == 0


def test_pii_learns_contexts(spark):
    seeds = [(i, f"please call me at +1 (504) 555-26{i:02d} today") for i in range(20)]
    docs = prepare(spark).createDataFrame([*seeds, (50, "please call me at 5045551234 now"), (51, "page 20010 of it")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert found[50] == "phone:18:28" and found[51] == ""


def test_decontamination(spark, odd, none):
    rng = random.Random(3)
    item = " ".join(f"item{i}" for i in range(30))
    items = [(1, item), (2, "Three short words"), (3, ""), (4, None), (10, " ".join(item.split()[5:20]))]
    benchmark = prepare(spark).createDataFrame(items, "item_id long, text string")
    texts = [item, f"{LONG[:500]} {item}", item.upper(), "three, SHORT; words", "three short", "", None, " ".join(item.split()[:12])]
    texts += [" ".join(rng.choice(item.split()[:15]) for _ in range(200)) for _ in range(3)]
    docs = prepare(spark).createDataFrame([*enumerate(texts), (0, item), (None, item)], "doc_id long, text string")
    docs = docs.withColumn("hash", F.lit(1)).withColumn("len", F.lit("x"))
    rows = decontamination.contamination(docs, benchmark).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        n, hit, found = contamination(texts[r.doc_id or 0], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    bad = {r.doc_id for r in rows if r.contaminated}
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and not bad & {r.doc_id for r in kept.collect()}
    spans = decontamination.decontaminate(docs, benchmark, action="spans")
    cleaned = {r.doc_id: r.text for r in spans.collect()}
    assert cleaned[3] == ",  ; ".replace("  ", " ") or cleaned[3] == ", ; "
    assert cleaned[4] == "three short" and cleaned[6] is None
    assert decontamination.contamination(none, benchmark).count() == 0
    assert {r.n_hit for r in decontamination.contamination(odd, benchmark.limit(0)).collect()} == {0}


def test_decontamination_without_broadcast(spark, documents, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    first = sorted(map(tuple, decontamination.contamination(documents, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontamination.contamination(documents, benchmark).collect())) == first


def test_near_duplicates(spark, odd, none, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = near_dups.near_duplicates(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_components(texts.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    rows = near_dups.near_duplicates(odd).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == near_components(enumerate(TEXTS))
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None) and len(rows) == len(TEXTS) + 3
    assert near_dups.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_large_bucket(spark, monkeypatch):
    """Chains of edits: most links are not with the first pivot."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        if i % 3 == 0:
            base = [*base]
            base[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w if rng.random() > 0.01 else f"y{i}" for w in base)))
    monkeypatch.setattr(near_dups, "OFTEN", 2)
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert got == near_components(rows)


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    for n in (3, 40, 2000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[: n * 2 // 3], rng.integers(0, 1 << 63, n - n * 2 // 3).astype(np.uint64)))
        x = near_dups.super_minhash(np.concatenate((a, b)), np.array([0, n, 2 * n]), 1024)
        common = n * 2 // 3
        assert abs((x[0] == x[1]).mean() - common / (2 * n - common)) < 0.08


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = components(prepare(spark).createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.root for r in rows} == {i: find(i) for i in range(500) if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_templates(spark, odd, none):
    def line(i):
        return f"Page {i} of {i + 5} in the printed book"

    own = [" ".join(chr(97 + i) + w for w in ("some", "words", "of", "its", "own", "alone")) for i in range(8)]
    texts = [f"{own[i]}\nAll rights reserved by us\n{line(i)}\nhi" for i in range(4)]
    texts += [f"{own[4]}\nAll rights reserved by us", "user anna logged in from the office", "user bert logged in from the office", "user carl logged in from the office\nx y"]
    docs = prepare(spark).createDataFrame([*enumerate(texts), (1, texts[1]), (99, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert rows[0].text == texts[0] and rows[1].text == f"{own[1]}\nhi" and rows[4].text == own[4]
    assert (rows[5].text, rows[6].text, rows[7].text) == (texts[5], texts[6], "user carl logged in from the office\nx y")
    general = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs, same=0.9, constant=0.7, leading=1).collect()}
    assert general[5] == texts[5] and general[6] == "" and general[7] == "x y"
    assert rows[99].text is None and (rows[99].n_lines, rows[1].n_dropped) == (0, 2)
    whole = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs, copy_share=0.25).collect()}
    assert whole[1] == texts[1]
    cleaned = line_templates.drop_recurring_lines(odd)
    assert cleaned.count() == odd.count() and cleaned.columns.count("n_lines") == 1
    assert line_templates.drop_recurring_lines(none).count() == 0


def test_passage_inside_a_line(spark):
    def words(k, n):
        return " ".join(f"{chr(97 + k)}{chr(97 + i)}" for i in range(n))

    passage = f"{words(0, 12)}. {words(1, 2)}? {words(2, 16)}."
    texts = [f"{words(3 + i, 9)}. {passage} {words(8 + i, 7)}.\n{words(13 + i, 5)}" for i in range(4)]
    texts += [f"Yes it is. {words(20 + i, 9)}." for i in range(4)]
    docs = prepare(spark).createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert rows[0].text == texts[0]
    for i in range(1, 4):
        assert rows[i].text == texts[i].replace(f" {passage}", "") and (rows[i].n_lines, rows[i].n_dropped) == (2, 0)
    assert all(rows[i].text == texts[i] for i in range(4, 8))  # a short sentence alone is no passage


def test_lines_of_two_documents(spark):
    def words(k, n):
        return " ".join(f"{chr(97 + k)}{chr(97 + i)}" for i in range(n))

    shared = [words(0, 11), words(1, 5), words(2, 14)]
    texts = ["\n".join([words(3, 9), *shared]), "\n".join([*shared, words(4, 9)]), words(5, 4), f"{words(5, 4)}\n{words(6, 9)}"]
    docs = prepare(spark).createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()}
    # a short line alone needs a third document
    assert rows == {0: texts[0], 1: words(4, 9), 2: texts[2], 3: texts[3]}


def test_leaf_of_two_templates_and_noise(spark):
    names = [f"{chr(97 + i)}xy" for i in range(8)]
    first = [f"the price was set by {n} in our main shop" for n in names]
    second = [f"the price was high when {n} came to us again" for n in names]
    noise = ["the price was never known or told or seen at"]
    docs = prepare(spark).createDataFrame([*enumerate(first + second + noise)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()}
    assert sorted(i for i in rows if rows[i]) == [0, 8, 16]
    docs = spark.createDataFrame([*enumerate(first + noise)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()}
    assert sorted(i for i in rows if rows[i]) == [0, 8]


def test_language(spark, odd, none):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    rows = {r.doc_id: r for r in language.identify(odd).collect() if r.doc_id is not None}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[10].lang_pred == "und" and rows[5].lang_pred == "en"
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, odd, none):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
    assert toxicity.toxicity(odd, labels).count() == odd.count() and toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}


def test_toxicity_above_ten_thousand_labels(spark):
    rng = random.Random(3)
    rare = [f"slur{k}" for k in range(60)]
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(6)), 0) for i in range(10_500)]
    rows += [(20_000 + i, " ".join([rare[i % 60], *(f"w{rng.randrange(300)}" for _ in range(6))]), 1) for i in range(480)]
    rows += [(30_000 + i, "the very same text", 0) for i in range(500)]  # copies
    labelled = prepare(spark).createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn_weights(labelled)
    fresh = spark.createDataFrame([(f"w1 w2 {x} w3 w4 w5",) for x in rare], "text string")
    assert sum(r.score >= 0.5 for r in toxicity.score(fresh, model).collect()) >= 0.9 * len(rare)


def test_url_rules(spark):
    def plain(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        path = rest[cut:]
        return lower(rest[:cut]), path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]

    urls = [None, "", "no scheme", "http://A.Org/x?y#z", "http://org", "http://ORG/", "http://xorg/", "https://example.org/es/1", "https://m.example.org/en/12", "http://a.com/fr/", "x://b.com/de/9", "http://é.com?q=/fr/", "://org/#", "http://u@h.com:80/fr/x://org/"]
    pages = [*enumerate(urls), (None, "http://org/"), (3, "http://org/")]
    pages += [(100 + i, f"http://h{i}.com/{'fr' if i % 2 else 'de'}/ads/{i}") for i in range(60)]
    pages += [(500, "http://new.net/fr/7"), (501, "http://new.net/de/ads/7")]
    df = prepare(spark).createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(0))
    rows = url_rules.judge_urls(df).collect()
    assert len(rows) == len(pages)
    by_id = {r.page_id: r for r in rows}
    for i, url in enumerate(urls):
        host, path = plain(url)
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.LIST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if i != 3:
            assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, max(fits)[1] if fits else None)
    assert (by_id[500].verdict, by_id[501].verdict) == ("allow", "block") and by_id[501].learned
    assert url_rules.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(df.where("page_id < 3 and page_id is not null and url is null")).collect()} == {"allow"}


def test_language_shares_hold_few_texts_at_once():
    import tracemalloc

    one = pa.array([None, "", "the cat", "x" * 300_000, "le chat", "éé"])
    parts = list(language.slices(one))
    assert [k for part in parts for k in range(part.start, part.stop)] == list(range(6)) and len(parts) == 3
    assert not list(language.slices(one[:0]))
    model = language.build_filters({"en": language.grams(one[2:3])[0], "fr": language.grams(one[4:5])[0]})
    assert np.array_equal(model.shares(one), np.concatenate([model._shares(one[k : k + 1]) for k in range(6)]))
    assert model.shares(one[:0]).shape == (0, 2)
    texts = pa.array(["some text of a page " * 100] * 2_000)  # 4 MB, a batch
    model.shares(texts[:1])
    tracemalloc.start()
    model.shares(texts)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_language_tasks_give_back_the_vocabularies_of_earlier_ones():
    tokens.encoder(tokens.default_tokenizer()).encode(pa.array(["some words"]), 1)
    tokens.release()
    assert tokens.encoder.cache_info().currsize == 0
    assert len(tokens.encoder(tokens.default_tokenizer()).encode(pa.array(["some words"]), 1)[0])


def test_signing_holds_a_slice_of_a_batch_and_gives_memory_back():
    # in a process of its own, as memory that was used once stays with it
    code = """
import resource
import numpy as np, pyarrow as pa
from linkloom.llm import near_dups
rng = np.random.default_rng(1)
texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**9, 400)) for _ in range(3000)] + [None, "", "A b"]
n = len(texts)
batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], ["doc_id", "key_text", "text"])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before = peak()
for out in near_dups._sign(iter([batch])):
    pass
print(peak() - before)
rows = pa.Table.from_batches(list(near_dups._sign(iter([batch]))))
near_dups.SLICE_BYTES = 1 << 40
assert rows.combine_chunks().equals(pa.Table.from_batches(list(near_dups._sign(iter([batch])))).combine_chunks())
"""
    import os
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 140, out.stdout

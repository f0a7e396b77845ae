"""Alignment, main text and whitening against plain forms of their contracts."""

import hashlib
import os
import re
from collections import Counter
from html import unescape

import brute
import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import alignment, line_templates, main_text, page_blocks, tokens, whitening
from linkloom.llm import messages as line_messages

SF = "/root/testdata/sf0.001"

ODD = [
    None, "", "a", " a", "a ", "a  b", "a\nb", "a \n b", "x   y", "▁x", "é à ça <|endoftext|> b<s>", "日本語 テスト",
    "tab\tx", "a b c", "don't we'll 123 45.6!", "éo", "́ x", "ﬁ ½", "😀 ok😀😀", "ß ẞ İ I", "\x00 a",
    "<0x0A> <unk>", "a.b,c;!?", "word " * 400 + "end",
]


def vocabularies():
    return tokens.public_vocabulary("byte_bpe_50k.json"), tokens.public_vocabulary("piece_bpe_32k.model")


def brute_alignment(texts):
    """Rows of the alignment digest, by the letter of its contract."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = vocabularies()
    a_tok, b_tok = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_tok.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(tokens.byte_alphabet())}
    rows, linked = [], []
    for text in texts:
        spaced = (" " + (text or "")).encode()
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
        pieces = [b_tok.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(a_bytes) != spaced or b"".join(b_bytes) != spaced:
            a, b, a_bytes, b_bytes = [], [], [], []
        owner = lambda parts: [k for k, p in enumerate(parts) for _ in p]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(owner(a_bytes), owner(b_bytes))))]
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        groups, i, j = [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            k, m = np.searchsorted(a_end, end) + 1, np.searchsorted(b_end, end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        rows.append((len(a), len(b), groups, links))
        linked.append(set(links))
    count = Counter(p for s in linked for p in s)
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [
        (
            n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in rows
    ]


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST_PAIRS, 20])
def test_alignment_agrees_with_brute_force(spark, broadcast):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = ODD + [r["text"] for r in docs.collect()]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    got = alignment.alignment_digest(table, *vocabularies(), broadcast_pairs=broadcast).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == dict(enumerate(brute_alignment(texts)))


def test_alignment_outputs_fit_together(spark):
    table = spark.createDataFrame([(7, "Nicht aulich, für sch"), (7, "Nicht aulich, für sch"), (None, "a b")], "doc_id long, text string")
    rows = alignment.align(table, *vocabularies(), ["a_ids", "b_ids", "a_group", "b_group", "links", "groups"]).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["7", "7", "None"]
    for r in rows:
        parts = [""] * r["n_groups"]
        for k in range(r["n_groups"]):
            side = lambda ids, of: ",".join(str(i) for i, g in zip(ids, of) if g == k)  # noqa: E731,B023
            parts[k] = side(r["a_ids"], r["a_group"]) + "|" + side(r["b_ids"], r["b_group"])
        assert ";".join(parts) == r["groups"]
        assert all(r["a_group"][x["a"]] == r["b_group"][x["b"]] for x in r["links"])
    assert alignment.align(table.limit(0), *vocabularies(), []).count() == 0


def test_as_of_merge_stays_in_its_document():
    doc, start = np.array([0, 0, 1, 1]), np.array([0, 4, 7, 9])
    other_doc, other_start = np.array([0, 1, 1]), np.array([0, 7, 8])
    assert alignment.covering(doc, start, other_doc, other_start).tolist() == [0, 0, 1, 2]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_any_tokenizer_are_the_librarys(name):
    from tokenizers import Tokenizer

    path = tokens.public_vocabulary(name)
    library = Tokenizer.from_file(path)
    texts = [t or "" for t in ODD] + ["Schöne Straße!'s it's <|ENDOFTEXT|> <|endoftext|>x 1234", "x" * 5000]
    wanted = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    ids, bounds = tokens.encoder(path).encode(pa.array(texts), 1)
    assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == wanted
    for text, want in zip(texts, wanted):  # alone, too
        assert tokens.encoder(path).encode(pa.array([text]), 1)[0].tolist() == want


def test_a_batch_of_distinct_words_takes_little_memory():
    code = """
import random, pyarrow as pa
from linkloom.llm import tokens
def resident():
    return int(open('/proc/self/statm').read().split()[1]) * 4096 / 1e6
random.seed(1)
e = tokens.encoder(tokens.default_tokenizer())
e.encode(pa.array(['warm up']), 1)
before = resident()
text = ' '.join(''.join(random.choices('abcdefghijklmnopqrstuvwxyz', k=8)) for _ in range(460_000))
e.encode(pa.array([text[i:i + 4000] for i in range(0, len(text), 4000)]), 1)
print(resident() - before)
"""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(out.stdout) < 250, out.stderr


def test_memory_of_words_is_bounded_and_right():
    asked = []
    remembered = tokens.Remembered(lambda words: asked.append(words) or [w.encode() for w in words], limit=40 * 170)
    for k in range(30):
        words = [f"w{k}-{i}" for i in range(5)] + ["often"]
        assert remembered(words) == [w.encode() for w in words]
        assert len(remembered.memory) + len(remembered.older) <= 60
    assert sum("often" in words for words in asked) == 1  # what comes again is kept


def test_words_are_encoded_together_and_odd_ones_alone():
    odd = ["\u2581x", "x\u2581\u2581", "\n", "a\n", "\xa0b", "c\u3000d", "\ufb01", "<s>", "</s>", "\x85", "e\u0301", "\0", "<0x41>", "", "two words"]
    words = [f"word{i}" for i in range(1_200)] + odd + ["caf\u00e9", "\u6f22\u5b57", "oh.\nyes"]
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        one = alignment.Side(tokens.public_vocabulary(name))
        asked, encode = [], one.vocabulary.encode
        one.vocabulary.encode = lambda texts: asked.extend(texts) or encode(texts)
        alone = [(ids, one.spelled(np.frombuffer(ids, "<u4")) == f" {w}".encode()) for w, ids in zip(words, encode(words))]
        assert one._marked(words) == [ids + bytes([exact, 0, 0, 0]) for ids, exact in alone]
        # only the run that odd words stand in is encoded again by words
        assert len(asked) < len(words) // 2


ARTICLE = re.compile(r"<article>(.*?)</article>", re.S)


def plain_article(html):
    inside = re.sub(r"</?(?:p|h1)>", "\n\n", ARTICLE.search(html)[1]).replace("<br>", " ")
    parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in inside.split("\n\n"))
    return "\n".join(p for p in parts if p)


def test_main_text_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in main_text.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["url"]) == (plain_article(r["html"]), r["url"])
        assert got[r["page_id"]]["n_chars"] == len(plain_article(r["html"]))
    assert sum(r["n_repeated"] for r in got.values()) > 0


def soup(menu, body, foot):
    return f"<html><body><div><a>{menu}</a></div><div>{body}</div><div>{foot}</div></body></html>"


@pytest.mark.parametrize("broadcast", [main_text.BROADCAST_SUFFIXES, 0])
def test_repeated_runs_of_a_host_go_and_unique_ones_stay(spark, broadcast):
    menu, foot = "home news sport culture science travel contact", "all rights reserved by the great example company"
    story = lambda i: " ".join(f"word{i}{c}" for c in "abcdefghij")
    pages = [(i, f"http://A.example/{i}", soup(menu, story(i), foot)) for i in range(6)]
    pages += [
        (6, "http://other.example/x", soup(menu, "alone on its host", foot)),
        (7, "http://a.example/copy", soup(menu, story(0), foot)),
        (8, "http://a.example/empty", None),
        (9, None, ""),
        (10, "http://a.example/all", soup(menu, "", foot)),
        (10, "http://a.example/near", f"<nav>{menu}</nav><article><h1>{menu}</h1><p>x &lt; y<br>z</article>"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as blocks", "2 as row").repartition(3)
    got = {(r["page_id"], r["url"]): r["text"] for r in main_text.main_text(table, broadcast_suffixes=broadcast).collect()}
    for i in range(6):
        assert got[i, f"http://A.example/{i}"] == story(i)
    # a menu met once on its host is text like any other; copies of a page do not repeat each other
    assert got[6, "http://other.example/x"] == f"{menu}\nalone on its host\n{foot}"
    assert got[7, "http://a.example/copy"] == got[0, "http://A.example/0"]
    assert got[8, "http://a.example/empty"] == got[9, None] == got[10, "http://a.example/all"] == ""
    assert got[10, "http://a.example/near"] == f"{menu}\nx < y z"  # repeated, but the article's


def test_both_sides_share_one_bounded_memory_of_words():
    sides = tuple(alignment.Side(path) for path in vocabularies())
    asked, encodes = [[], []], [one.vocabulary.encode for one in sides]
    for seen, one, encode in zip(asked, sides, encodes):
        one.vocabulary.encode = lambda texts, seen=seen, encode=encode: seen.extend(w for t in texts for w in t.split(" ")) or encode(texts)
    known = alignment.Words(sides, limit=300 * 300)
    for k in range(40):
        words = [f"word{k}x{i}" for i in range(60)] + ["often", "\ufb01", f"x\u2581{k}", "l" * 50, "two words"]
        number, coded = known(pa.array(words))
        for one, encode, c in zip(sides, encodes, coded):
            ends = np.cumsum(c.sizes)
            got = [(c.ids[ends[i] - c.sizes[i] : ends[i]].tobytes(), c.exact[i]) for i in number]
            assert got == [(ids, one.spelled(np.frombuffer(ids, "<u4")) == f" {w}".encode()) for w, ids in zip(words, encode(words))]
        assert len(known.names) == len(known.numbers) == len(known.coded[0].sizes) <= 400
    for seen in asked:
        assert seen.count("often") <= 2  # once among others, again alone where these are odd; what comes again is kept
        assert seen.count("l" * 50) >= 40  # long words are not


@pytest.mark.parametrize("broadcast", [main_text.BROADCAST_SUFFIXES, 0])
def test_runs_that_stand_in_a_marked_article_are_repeated_elsewhere(spark, broadcast):
    quoted, own = "one two three four five six seven eight", "red green blue black white grey brown pink"
    pages = [
        (1, "http://a.example/1", f"<article><h1>title</h1><p>{quoted}</article><div>{own}</div>"),
        (2, "http://a.example/2", soup(quoted, "alpha beta gamma delta epsilon zeta eta theta", "far away from it all in the hills")),
        (3, "http://b.example/3", soup(quoted, "nothing else", "here")),
        # the article of a copy is the page's own
        (4, "http://c.example/4", f"<article><p>{quoted}</article><div>{quoted}</div>"),
        (5, "http://c.example/5", f"<article><p>{quoted}</article><div>{quoted}</div>"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in main_text.main_text(table, broadcast_suffixes=broadcast).collect()}
    assert got[1]["text"] == f"title\n{quoted}" and got[1]["n_repeated"] == 0
    assert got[2]["text"] == "alpha beta gamma delta epsilon zeta eta theta\nfar away from it all in the hills"
    assert got[2]["n_repeated"] == 8
    assert got[3]["text"] == f"{quoted}\nnothing else\nhere"
    assert got[4]["text"] == got[5]["text"] == quoted and got[4]["n_repeated"] == got[5]["n_repeated"] == 0


def test_hashes_see_what_stands_behind_a_nul():
    a, b = main_text._hashes(["a\0b", "a\0c"])
    assert a != b


def test_main_text_of_no_pages_and_of_a_long_one(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_text.main_text(empty).count() == 0
    long = "<article>" + "<p>some words of a long page" * 40_000 + "</article>"
    row = main_text.main_text(spark.createDataFrame([(1, "http://h/", long)], empty.schema)).first()
    assert row["text"].count("\n") == 39_999


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<p>a<p class=ad>x<p>b", [("a", 0), ("x", 1), ("b", 0)]),
        ("<div class='with-sidebar'><main><h1>T</h1><p>x &amp; y</div><section id=comments><article>c</article></section></main>", [("T", 2), ("x & y", 2), ("c", 1)]),
        ("<a href='x>y", []),
        ("a < b <i>c</i>", [("a < b c", 0)]),
        ("<!-->x<!-- y", [("x", 0)]),
        ("<ul><li>a<li class=menu>b<li>c</ul>", [("a", 0), ("b", 1), ("c", 0)]),
        ("<script>var a='</p>'</script>z<style>p{}</style><textarea>t</textarea>", [("z", 0)]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", [("1 2", 0), ("3", 0)]),
        ("<header>h</header><article><header><h1>T</h1></header>x<footer>f</footer><article>reply</article></article>", [("h", 1), ("T", 2), ("x", 2), ("f", 1), ("reply", 1)]),
        ("</p></div>&#x41;&am;&amp", [("A&am;&", 0)]),
        ("<p>a<span class=ad>b</span>c", [("ac", 0), ("b", 1)]),
        ("", []),
    ],
)
def test_blocks_of_odd_pages(html, wanted):
    assert [(b.text, b.role) for b in page_blocks.blocks(html)] == wanted


def brute_whitening(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    deviation = [int(sum(int(v) ** 2 for v in row)) for row in n * x - sums]
    return deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_agrees_with_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    odd = [(9001, None), (9002, []), (9003, [1.0] * 63 + [float("nan")]), (9004, [None] * 64), (9005, [float("inf")] * 64), (9006, [0.5])]
    hot = [(10_000 + i, list(rows[0]["embedding"])) for i in range(300)]
    plain = table.select("vec_id", "embedding")
    both = plain.unionByName(spark.createDataFrame(odd + hot, plain.schema)).selectExpr("*", "1 as x", "2 as weight", "'k' as key")
    got = whitening.whiten(both.repartition(5)).toPandas()
    vectors = {r["vec_id"]: list(r["embedding"]) for r in rows} | dict(hot)
    deviation, whitened, explained = brute_whitening(list(vectors.values()))
    assert set(got["vec_id"]) == set(vectors) and len(got) == 8 * len(vectors)
    assert (got["n"] == len(vectors)).all() and got["identity_error"].iloc[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(vectors)].to_numpy()
    signs = np.sign((wide * whitened).sum(axis=0))
    assert np.abs(wide * signs - whitened).max() < 1e-8
    assert got[got["component"] == 1].set_index("vec_id").loc[list(vectors)]["deviation"].tolist() == deviation
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)


def test_whitening_with_one_weight_and_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (None, [1.0, 3.0])]
    table = spark.createDataFrame(rows, schema)
    one = whitening.whiten(table, weights="one").toPandas()
    assert set(one["n"]) == {3} and len(one) == 8 and one["identity_error"].iloc[0] < 1e-9
    deviation, whitened, _ = brute_whitening([[0, 1], [2, 0], [1, 3]])
    assert set(one["deviation"]) == set(deviation)
    assert np.allclose(sorted(np.abs(one["whitened"]).round(9).unique()), sorted(np.unique(np.abs(whitened).round(9))))
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)).count() == 0
    vectors = whitening.whitened_vectors(whitening.whiten(table.where("vec_id is not null")).dropDuplicates(["vec_id", "component"]))
    assert {r["vec_id"]: len(r["vector"]) for r in vectors.collect()} == {1: 1, 2: 1}


def test_whole_numbers_are_exact_where_64_bits_do_not_hold_them():
    x = np.array([[1 << 53, -(1 << 53)], [0, 5]], np.int64)
    off = whitening._differences(x, 10_000, [1 << 53, 5 - (1 << 53)])
    assert off[1].tolist() == [-(1 << 53), 10_000 * 5 - 5 + (1 << 53)]
    assert whitening._squares(off).to_pylist() == [None, None]
    assert whitening._squares(np.array([[3, 4]], object)).to_pylist() == [25]


def test_words_are_made_once_for_all_claims(spark):
    from linkloom.llm import decontamination
    from linkloom.llm.common import prepare

    plans = []
    real = decontamination.written

    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, label)

    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontamination, "written", watched)
        decontamination.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    plan = dict(plans)["window-verified"]
    inner = plan[plan.index("filter(") :]
    assert "regexp_extract_all" not in inner[: inner.index("Join")].split("lambdafunction(")[-1]
    assert plan.count("regexp_extract_all") == 1 and "LeftSemi" in plan


def test_rows_that_repeat_an_id_go_by_their_own_text(spark):
    from linkloom.llm import exact_dedup, near_dups
    from linkloom.llm.common import prepare

    rows = [(5, "a b c d e f"), (5, "x y z u v w"), (3, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key_text", "2 as kept")
    left = sorted(((r["doc_id"], r["text"]) for r in near_dups.drop_near_duplicates(docs).collect()), key=repr)
    assert left == sorted([rows[1], rows[2], rows[3], rows[4]], key=repr)
    # the largest id of equal texts stays
    left = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(docs).collect()), key=repr)
    assert left == sorted([rows[0], rows[1], rows[3], rows[4]], key=repr)


def test_a_text_of_one_letter_is_judged_alike_in_any_batch():
    from linkloom.llm import language

    alone, bounds = language.grams(pa.array(["a"]))
    both, ends = language.grams(pa.array(["a", "some other text"]))
    assert alone.tolist() == both[: ends[1]].tolist() and bounds.tolist() == [0, 1]


def brute_ftrl(rows, toxic, bits, epochs=6, alpha=2.0, beta=1.0, l1=6.0, l2=0.02):
    """The training rule written out for one feature at a time."""
    import math

    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0
    prior = min(max(sum(toxic) / len(toxic), 1e-3), 1 - 1e-3)
    start, more = math.log(prior / (1 - prior)), max(1.0, math.sqrt((1 - prior) / prior))
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    bias = lambda: start - zb / ((beta + math.sqrt(nb)) / alpha)
    for _ in range(epochs):
        for row, y in zip(rows, toxic):
            w, b = {i: weight(i) for i in row.tolist()}, bias()
            g = (1 / (1 + math.exp(-(sum(w.values()) + b))) - y) * (more if y else 1.0)
            for i, wi in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * wi
                n[i] += g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * (b - start), nb + g * g
    return {i: weight(i) for i in z if weight(i)}, bias()


def test_training_follows_the_rule_feature_by_feature():
    from linkloom.llm import toxicity

    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(120)]
    toxic = np.array([float(3 in r or 7 in r) for r in rows])
    weights, bias = toxicity.train_ftrl(rows, toxic)
    wanted, wanted_bias = brute_ftrl(rows, toxic.tolist(), 40)
    assert abs(bias - wanted_bias) < 1e-9 and {i: round(w, 9) for i, w in enumerate(weights) if w} == {i: round(w, 9) for i, w in wanted.items()}


def test_labels_are_chosen_by_id_and_bounded(spark):
    from linkloom.llm import toxicity

    labels = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert toxicity.choose_labels(labels, 1000).count() <= 1000
    assert toxicity.choose_labels(labels, 5000).count() == 5000
    assert toxicity.choose_labels(labels.selectExpr("7L as doc_id", "toxic"), 10).count() <= 10


@pytest.mark.parametrize("small, broadcast", [(5_000, 4_000_000), (3, 0)])
def test_line_templates_agree_with_a_plain_tree(spark, monkeypatch, small, broadcast):
    from brute import recurring

    from linkloom.llm import line_templates
    from linkloom.llm.common import prepare

    monkeypatch.setattr(line_templates, "SMALL_LEAF", small)
    monkeypatch.setattr(line_templates, "BROADCAST_LEAVES", broadcast)
    monkeypatch.setattr(line_templates, "BROADCAST_TEMPLATES", broadcast)
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    if small == 3:  # fewer, since each level is a round of jobs
        texts = texts[:40]
    odd = ["文。字！x 。\n。\n1.5 a. b.\t c? ?\n\n", "文。字！x 。\n。\n2.5 a. b.\t c? ?\n\n", "", None, " \n. . .", "é. é. <*> 7", "é. é. 7 <*>"]
    names = [f"{chr(97 + i)}xy" for i in range(8)]
    odd += [f"the price was {w} {n} in our main shop today" for w in ("set by", "high for", "low at") for n in names]
    texts += [(100_000 + i, t) for i, t in enumerate(odd)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = line_templates.recurring_lines(table)
    rows = [(r["key_id"], r["pos"], r["part"], r["at"], r["n"], r["n_docs"], r["first"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(recurring(texts), key=repr)


def test_trees_of_random_leaves_are_the_plain_ones():
    from brute import line_tree

    from linkloom.llm.messages import template_tree

    rng = np.random.default_rng(4)
    for _ in range(300):
        size, width = rng.integers(2, 14), rng.integers(1, 8)
        lines = np.unique(rng.integers(0, rng.integers(2, 6), (size, width)), axis=0)
        got = template_tree(lines.astype(np.uint64), 0.6, 0.5)
        plain = line_tree([tuple(map(int, x)) for x in lines], 0.6, 0.5)
        groups = {}
        for line, k in zip(map(lambda x: tuple(map(int, x)), lines), got):
            assert bool(k) == (line in plain)
            if k:
                assert groups.setdefault(int(k), plain[line]) == plain[line]
        assert len(set(groups.values())) == len(groups)


def test_messages_of_arrow_texts_stand_where_plain_python_finds_them():
    texts = [bytes(range(128)).decode(), "", "a. b!\tc? d.e\n\nx1 y z", "。。a！\nb？ c \U0001f600.", "\xe9\x85   w.", "\n", " . . ", "a. b!\tc? d.e"]
    table = pa.array(["left out", *texts])
    m = line_messages.messages(table[1:], least_tokens=3, leading=3)
    got = sorted(zip(*(x.tolist() for x in (m.text, m.pos, m.part, m.at, m.n))))
    plain = [(i, *x) for i, text in enumerate(texts) for x in brute.line_messages(text)]
    assert got == sorted((i, pos, part, -1 if at is None else at, len(words)) for i, pos, part, at, words in plain)
    # a message's hashes are the same wherever it stands
    for i, text in enumerate(texts):
        alone, mine = line_messages.messages(pa.array([text]), 3, 3), m.text == i
        assert all((getattr(alone, x) == getattr(m, x)[mine]).all() for x in ("pos", "part", "at", "a", "b", "leaf"))
    for line in "\n".join(texts).split("\n"):
        assert line_templates._sentences(line) == re.split(brute.SENTENCE_END, line)

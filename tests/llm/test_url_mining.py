import itertools
import random
import time

from linkloom.llm import url_rules
from linkloom.llm.common import prepare
from pyspark.sql import functions as F

SUPPORT, CONFIDENCE, LONGEST = 0.05, 0.7, 3


def mined(examples):
    """Rules of every combination of tokens, counted one by one, pruned by their parts."""
    tokens = sorted({t for ts, _ in examples for t in ts})
    least = SUPPORT * len(examples)
    found = {}
    for size in range(1, LONGEST + 1):
        for combination in itertools.combinations(tokens, size):
            verdicts = [v for ts, v in examples if set(combination) <= ts]
            for verdict in set(verdicts):
                n = verdicts.count(verdict)
                if n >= least and n / len(verdicts) >= CONFIDENCE:
                    found[combination, verdict] = (n / len(verdicts), n)
    return {
        (c, v): score
        for (c, v), score in found.items()
        if not any(found.get((part, v), (0,))[0] >= score[0] for part in itertools.combinations(c, len(c) - 1))
    }


def test_mined_verdicts_are_those_of_brute_force(spark):
    pick = random.Random(5)
    words = ["ads", "shop", "news", "blog", "img", "cart"]

    def url(i, ends):
        path = "/".join(pick.sample(words, pick.randint(1, 4)))
        return f"http://h{i}.{pick.choice(ends)}/{pick.choice(['fr', 'de', 'it'])}/{path}/twin/pair/{i}"

    pages = [(i, url(i, ["com"] if i < 240 else ["net", "edu"])) for i in range(300)]
    df = prepare(spark).createDataFrame(pages, "page_id long, url string")
    tokens = {r.page_id: set(r.t) for r in df.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    rows = url_rules.judge_urls(df, support=SUPPORT, confidence=CONFIDENCE, longest=LONGEST, default="none").collect()
    listed = [(tokens[r.page_id], r.verdict) for r in rows if r.rule]
    rules = mined(listed)
    assert len(listed) > 100 and any(len(c) > 1 for c, _ in rules)
    compared = 0
    for r in rows:
        if r.rule:
            continue
        fits = [(score, v) for (c, v), score in rules.items() if set(c) <= tokens[r.page_id]]
        best = {v for score, v in fits if score == max(s for s, _ in fits)}
        assert r.verdict in (best or {"none"}), (r, fits)
        compared += len(best) == 1
    assert compared > 30 and {r.verdict for r in rows} == {"allow", "block", "none"}


def test_long_shared_paths_and_long_urls(spark):
    path = "/".join(f"part{chr(97 + i)}" for i in range(25))
    pages = [(i, f"http://h{i}.com/{'fr' if i % 2 else 'de'}/{path}/{i}") for i in range(100)]
    pages += [(200, f"http://new.net/fr/{path}"), (201, "http://long.net/de/" + "x/" * 200_000), (202, "http://part.net/party/")]
    df = prepare(spark).createDataFrame(pages, "page_id long, url string").withColumn("token", F.lit("clash"))
    begun = time.monotonic()
    verdicts = {r.page_id: r.verdict for r in url_rules.judge_urls(df, default="none").collect()}
    assert time.monotonic() - begun < 20
    assert (verdicts[200], verdicts[201], verdicts[202]) == ("allow", "block", "none")

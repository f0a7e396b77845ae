import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from linkloom.functions import regex_match as rm

ODD = [
    r"colou?r", r"/a{2}bcd/", r"x\.html$", r"[a-z]ending[0-9]", r"(group)tail+s", r"one|other", r"(?i)CASE", r"\x41bcd", r"^http://h7\.",
    r"[^]]after", r"[]x]within", r"q\?page=\d+", r"abc*defg", r"\Qa.b\E", r"(?:left|right)/side", r"tr.ck(ing)?/pixel", r"pre\bword",
]


@pytest.mark.parametrize("pattern, text", [
    (r"colou?r", "colo"), (r"/wp-admin/", "/wp-admin/"), (r"x\.html$", "x.html"), (r"one|other", None), (r"(?i)longer", None), (r"abc", None),
    (r"(group)tail+s", "tail"), (r"[a-z]ending[0-9]", "ending"), (r"aaaa{3}", None), (r"longest(x|y)short", "longest"), (r"\x41bcd", None),
])
def test_required_text(pattern, text):
    assert rm.required_text(pattern) == text


def test_many_patterns_agree_with_each_alone(spark):
    pick = random.Random(3)
    words = ["page", "Case", "color", "colour", "/aabcd/", "x.html", "bending7", "grouptails", "one", "q?page=12", "abdefg", "left/side", "xwithin", "preword", "Abcd"]
    values = [None, "", *("http://h%d.test/" % pick.randint(0, 9) + "".join(pick.sample(words, 3)) for _ in range(400))]
    patterns = ODD + [rf"/nothing{i}/" for i in range(rm.GROUP)]
    got = rm.ManyPatterns(patterns).search(pa.array(values)).to_pylist()
    alone = [pc.match_substring_regex(pa.array(values), p).to_pylist() for p in patterns]
    assert got == [None if v is None else any(a[i] for a in alone) for i, v in enumerate(values)]
    assert True in got and False in got
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    assert [r.m for r in df.select("id", rm.matches_any(F.col("v"), patterns).alias("m")).orderBy("id").collect()] == got


def test_thousands_of_long_patterns(spark):
    patterns = [rf"^https?://(www\.)?site{i}\.test/([a-z]{{1,60}}/){{2,16}}item{i}(\?[a-z]+=\d{{1,30}})?$" for i in range(20_000)]
    assert rm.re2_error(rm.alternation(patterns[: rm.GROUP]))  # so many are too large together
    urls = [f"http://site{i}.test/a/b/c/item{i + (i % 50 > 0)}?x=1" for i in range(3_000)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url for r in df.where(rm.matches_any(F.col("url"), patterns)).collect()}
    assert got == {u for i, u in enumerate(urls) if i % 50 == 0}
    assert all(re.search(patterns[i], urls[i]) for i in range(0, 3_000, 50))

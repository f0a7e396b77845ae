import json

import pytest
from pyspark.sql import functions as F

from linkloom.functions.ignore_list import FAMILIES
from linkloom.functions.regex_match import re2_error
from linkloom.sources import lists
from linkloom.sources.edges import write_edges


def test_seeds(spark):
    assert [tuple(r) for r in lists.seeds_df(spark, ["http://a/"]).collect()] == [("http://a/", 0, 0)]
    with pytest.raises(ValueError, match="%zz"):
        lists.seeds_df(spark, ["http://a/", "http://a/%zz"])


def test_url_files(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("http://a/\nhttp://b/%zz\nhttp://c/\n")
    assert lists.read_url_list(spark, str(path), mode="drop").count() == 2
    with pytest.raises(Exception, match="not a URL"):
        lists.read_url_list(spark, str(path)).collect()


def test_exclude_files(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("/a/\n\n\\d+$\n")
    bad.write_text("ok\n(?!x)\n")
    assert lists.read_exclude_patterns(spark, str(good)) == ["/a/", "\\d+$"]
    with pytest.raises(ValueError, match="bad.txt, line 2"):
        lists.read_exclude_patterns(spark, str(good), str(bad))


def test_pattern_import(spark, tmp_path):
    (tmp_path / "blogs.json").write_text(json.dumps({"name": "b", "patterns": ["/x/", "(.*)\\1", "a(?!b)"]}, indent=1))
    (tmp_path / "more.json").write_text(json.dumps({"patterns": ["/x/", "/y/"]}))
    found = lists.read_ignore_json(spark, f"{tmp_path}/*.json")
    assert {(r.family, r.pattern) for r in found.filter("error IS NOT NULL").collect()} == {("blogs", "(.*)\\1"), ("blogs", "a(?!b)")}
    used = lists.default_ignores(spark, f"{tmp_path}/*.json")
    assert {tuple(r) for r in used.collect()} == {("blogs", "/x/"), ("more", "/y/")}


def test_bundled_patterns(spark):
    sizes = {family: len(patterns) for family, patterns in FAMILIES.items()}
    assert sizes == {
        "WordPress": 3, "googleplus": 4, "mediawiki": 20, "nosortedindex": 1, "coppermine": 4, "youtube": 2, "reddit": 15,
        "nogravatar": 1, "meetupeverywhere": 1, "pinterest": 6, "blogs": 28, "twitter": 2, "imdb": 11, "facebook": 4, "forums": 27,
    }
    listed = lists.default_ignores(spark)
    assert listed.count() == listed.select("pattern").distinct().count()
    assert all(re2_error(r.pattern) is None for r in listed.collect())


def test_edges_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1)], "src_url string, url string, tag int")
    write_edges(df, f"{tmp_path}/e")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/e").collect()] == [("a", "b", 1, None)]
    with pytest.raises(ValueError):
        write_edges(df, f"{tmp_path}/f", "xls")
    assert F.col("x") is not None


def test_very_many_patterns(spark):
    from linkloom.functions.regex_match import matches_any

    df = spark.createDataFrame([("/item/19999/",), ("/item/x/",)], "url string")
    hit = matches_any(F.col("url"), [rf"/item/{k}/" for k in range(20000)])
    assert [r.url for r in df.filter(hit).collect()] == ["/item/19999/"]

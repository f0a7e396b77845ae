from pyspark.sql import functions as F

from linkloom.functions import markup
from linkloom.functions.html_reference import html_links_exact
from linkloom.operators.links import page_links
from workload import derived

CASES = [
    ('<a href="/x?a=1&amp;b=2&copy=3&eacute;&#38;&#x2F;q&#150;">t</a><A HREF=/y><a title="<a href=\'no\'>" href = "yes" href="2nd">',
     [("/x?a=1&b=2&copy=3é&/q–", 0), ("/y", 0), ("yes", 0)]),
    ('<!-- <a href="no"> --><script src="s.js">"<a href=no>"</script><noscript><img src=no></noscript>'
     '<iframe src=f><a href=no></iframe><a href="after">', [("s.js", 1), ("f", 1), ("after", 0)]),
    ('<a href><a name=x><a data-href="no"><object data="o"><source src=v><link rel=x href=c><img alt=">" src=i>',
     [("", 0), ("o", 1), ("v", 1), ("c", 1), ("i", 1)]),
    ("<title><a href=no></title><textarea><a href=no></textarea><area href=no><a\nhref\n=\n'nl'>", [("nl", 0)]),
    ('<a href="unclosed>x</a>', []),
    ("<a href=''>e</a><a href=a/b/></a href='x'><a/href=slash>", [("", 0), ("a/b/", 0), ("slash", 0)]),
]


def test_tags(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "id long, html string")
    for r in df.select("id", markup.html_links(F.col("html")).alias("l")).collect():
        assert [(x.raw, x.tag) for x in r.l] == CASES[r.id][1]


def test_long_pages_do_not_overflow(spark):
    html = "<a " + "x " * 100_000 + "href=/big><script>" + "y" * 1_000_000 + "</script><!--" + "-" * 100_000 + "--><a href=/e>"
    row = spark.createDataFrame([(html,)], "h string").select(markup.html_links(F.col("h")).alias("l")).first()
    assert [x.raw for x in row.l] == ["/big", "/e"]


def test_agrees_with_a_full_parser(spark):
    pages = derived.html_cases(spark, "/root/testdata/sf0.001")
    fast = pages.select("id", F.inline(markup.html_links(F.col("html"))))
    exact = html_links_exact(pages, "id", "html")
    assert fast.exceptAll(exact).count() == 0 and exact.exceptAll(fast).count() == 0


def test_css(spark):
    def links(css):
        return [x.raw for x in spark.createDataFrame([(css,)], "c string").select(markup.css_links(F.col("c")).alias("l")).first().l]

    assert links("a{b:url(1.png)}") == ["1.png"]
    assert links("a{b:url('1.png') url(\"2.png\")}") == ["2.png"]  # greedy: the last of a line
    assert links("a{b:url(1) x:y}" + "c:d;" * 50_000) == ["1"]  # a long tail costs nothing
    assert links("a{b:url(1)} c{d:url(") == ["1"]
    assert links("a{b:url(1)}\nc{d:url(2)}\r\n@import url(x);\n@import \"y\";") == ["1", "2", "x"]


def _links(spark, content_type, body):
    df = spark.createDataFrame([("https://example.com/", content_type, body)], "url string, content_type string, body string")
    return sorted((r.url, r.tag) for r in page_links(df).collect())


def test_page_links_of_known_pages(spark):
    expected = [("https://example.com/link1", 0)]
    assert _links(spark, "text/html", '<html><body>\n<a href="/link1">link</a>\n</body></html>') == expected
    style = "<html><head><style type=\"text/css\">\nbody { background: url('/link1'); }\n</style></head></html>"
    assert _links(spark, "text/html", style) == [("https://example.com/link1", 1)]
    assert _links(spark, "text/css", "a{b:url(/link1)}") == [("https://example.com/link1", 1)]
    assert _links(spark, "Text/html", '<a href="/link1">') == []


def test_page_links_are_unique_and_related_wins(spark):
    html = '<a href="/i"><a href="i"><img src="https://example.com/i"><a href="/i#f"><a href="data:x"><a href="/%zz">'
    assert _links(spark, "text/html", html) == [("https://example.com/i", 1), ("https://example.com/i#f", 0)]


def test_extraction_does_not_shuffle(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("content_type", F.lit("text/html"))
    plan = page_links(pages, body="html")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_numeric_references(spark):
    page = '<a href="/x&#0000000065;&#x00000000000042;&#99999999999;">'
    row = spark.createDataFrame([(page,)], "html string").select(markup.html_links(F.col("html")).alias("l")).first()
    assert row.l[0][0] == "/xAB�"

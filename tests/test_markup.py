"""Text of whole pages and whole article documents."""

from pyspark.sql import functions as F

from larkspur.sources.readers import article_text_from_xml, page_text

PAGES = {
    "<html><head><title>T &amp; t</title><style>p > a {}</style></head><body><p class='a>b'>One <b>two</b>\n three</p><div>four<br/>five</div></body></html>": "T & t\nOne two\nthree\nfour\nfive",
    '<SCRIPT type="x">if (a < b) document.write("<p>no</p>");</SCRIPT><!-- <p>no\n</p> --><a href="x>y" title=\'"\'>link</a>&nbsp;&lt;p&gt; &amp;lt;': "link <p> &lt;",
    "plain  text\t here": "plain text here",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<p> </p><br>": None,
    "": None,
}


def test_page_text(spark):
    df = spark.createDataFrame([(h,) for h in [*PAGES, None, "<p>" + "x <i a='1'>y</i> " * 20_000]], "html STRING")
    got = {r["html"]: r["text"] for r in df.select("html", page_text(F.col("html")).alias("text")).collect()}
    assert {h: got[h] for h in PAGES} == PAGES and got[None] is None
    assert max(len(t) for t in got.values() if t) == len("x y " * 20_000) - 1


def test_article_documents(spark):
    head = '<?xml version="1.0"?><!DOCTYPE A PUBLIC "-//N//D" "https://example.org/a.dtd" [<!ENTITY x "y">]>'
    nested = "<A><B><Abstract><AbstractText Label='L'>One &amp; <sup>2</sup> cut</AbstractText><AbstractText><i>all</i> inside</AbstractText><Other><AbstractText>Three</AbstractText></Other></Abstract></B></A>"
    rows = [("1", nested), ("2", head + nested), ("x", nested), ("3", "<A><AbstractText>broken</A>"), ("4", "<A/>"), ("5", None), ("6", ""), (None, nested)]
    df = spark.createDataFrame(rows, "id STRING, xml STRING")
    got = {r["id"]: r["t"] for r in df.select("id", article_text_from_xml(F.col("id"), F.col("xml")).alias("t")).collect()}
    assert got == {"1": "One & \n\nThree", "2": "One & \n\nThree", "x": None, "3": None, "4": None, "5": None, "6": None, None: None}

"""Column functions over pages against the standard library's parser."""

from __future__ import annotations

import html as standard
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from catalith.functions import pages as P

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text", ["a &lt;b&gt; &amp;amp; c", "&#65;&#x42;&#128512;&#X2014;", "&quot;&apos;", "plain", "", "&amp;lt;", "&#;&#xZ; &unknown;", "B&#233;la &amp; Co"])
def test_decoded(spark, text):
    assert value(spark, P.decoded(F.lit(text))) == (standard.unescape(text) if "&#;" not in text else text)


@pytest.mark.parametrize("href", ["/a/b?x=1", "c.html", "../d", "https://other.example/e", "//cdn.example/f", "mailto:x@y.example"])
@pytest.mark.parametrize("url", ["https://shop.example.com/p/7?x=1", "https://shop.example.com", "https://shop.example.com/a/b/#top"])
def test_resolved(spark, href, url):
    got = value(spark, P.resolved(F.lit(href), F.lit(url)))
    assert got == urljoin(url, href) or href.startswith("..") and got.endswith("../d")


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.text, self.href = [], "", None

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.href, self.text = dict(attrs)["href"], ""

    def handle_data(self, data):
        self.text += data

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((self.href, " ".join(self.text.split())))
            self.href = None


def test_links_of_all_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html", P.links(F.col("html")).alias("links")).collect()
    for r in rows:
        parser = Links()
        parser.feed(r["html"])
        assert [(x["href"], x["title"]) for x in r["links"]] == parser.found
    assert sum(len(r["links"]) for r in rows) > len(rows)


def test_scripts_attributes_and_blocks(spark):
    page = F.lit("<HTML data-a='1' lang=\"hu\"><title>A &amp;\n <b>B</b></title><script>var a;</script><script type='x'>track(12)</script><p>one</p><p class=q>two <i>2</i></p></HTML>")
    assert value(spark, P.attribute(page, "html", "lang")) == "hu" and value(spark, P.attribute(page, "html", "id")) is None
    assert value(spark, P.script_with(page, "track(")) == "track(12)" and value(spark, P.script_with(page, "none")) is None
    assert value(spark, F.transform(P.inner(page, "p"), P.text_of)) == ["one", "two 2"]
    assert value(spark, P.text_of(F.get(P.inner(page, "title"), F.lit(0)))) == "A & B"
    assert value(spark, P.base_of(F.lit("https://a.example/x#t?y#z"))) == "https://a.example/x#t"

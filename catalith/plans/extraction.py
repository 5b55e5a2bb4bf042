"""Extraction from the pages table, in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions.pages import attribute, base_of, inner, links, resolved, script_with, text_of
from catalith.plans.define import Plans
from catalith.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

@P.query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
len(regexp_extract_all(html, '<li>'))::VARCHAR AS items, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def d1_d4_titles_and_languages(spark, sf):
    html = F.col("html")
    items = F.size(F.flatten(F.transform(inner(html, "nav"), lambda x: F.regexp_extract_all(x, F.lit(r"(?i)<li[\s>]"), F.lit(0)))))
    return table(spark, sf, "pages").select("page_id", text_of(F.get(inner(html, "title"), F.lit(0))).alias("title"), items.cast("string").alias("items"), attribute(html, "html", "lang").alias("lang"))


@P.query(r"""SELECT page_id, (i - 1)::INTEGER AS position, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || l[i] AS link, t[i] AS title FROM (
  SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS l, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t, unnest(range(1, len(regexp_extract_all(html, '<li><a href')) + 1)) AS i FROM pages)""")
def d35_link_pairs(spark, sf):
    """Links of the navigation's lists, resolved, with their titles."""
    found = F.flatten(F.transform(inner(F.col("html"), "nav"), lambda x: links(x, r"<li>\s*")))
    rows = table(spark, sf, "pages").select("page_id", "url", F.posexplode(F.filter(found, lambda x: x["href"].startswith("/"))).alias("position", "x"))
    return rows.select("page_id", "position", resolved(F.col("x.href"), F.col("url")).alias("link"), F.col("x.title").alias("title"))


@P.query("SELECT page_id, split_part(url, '?', 1) AS base, ceil((page_id % 97) / 20.0)::BIGINT::VARCHAR AS pages FROM pages WHERE page_id % 97 > 0")
def d39_d41_base_urls_and_pages(spark, sf):
    p = table(spark, sf, "pages").filter("page_id % 97 > 0")
    return p.select("page_id", base_of(F.col("url")).alias("base"), F.ceil(F.col("page_id") % 97 / 20.0).cast("string").alias("pages"))


@P.query(r"SELECT page_id, regexp_extract(html, 'track\((\d+)\)', 1)::DOUBLE::BIGINT AS track, regexp_extract(url, '/([a-z]{2})/', 1) AS section FROM pages")
def d22_d24_script_values(spark, sf):
    """A number out of the script that calls a function, and a part of the address."""
    track = F.regexp_extract(script_with(F.col("html"), "track("), r"track\((\d+)\)", 1).try_cast("long")
    return table(spark, sf, "pages").select("page_id", track.alias("track"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("section"))


@P.query("SELECT event_id, n AS page, 'https://shop.example.com/list?p=' || n || '&o=' || ((n - 1) * 24) AS link FROM (SELECT event_id, unnest(range(1, (event_id % 4) + 1)) AS n FROM events WHERE event_type = 'view')")
def d39_pagination_links(spark, sf):
    """The column form of pagination: no page is needed."""
    e = table(spark, sf, "events").filter("event_type = 'view' and event_id % 4 > 0")
    rows = e.select("event_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("event_id") % 4)).alias("page"))
    return rows.select("event_id", "page", F.format_string("https://shop.example.com/list?p=%d&o=%d", "page", (F.col("page") - 1) * 24).alias("link"))


@P.query("SELECT event_id, CASE WHEN (props::JSON->>'k')::INTEGER >= 50 THEN 'high' ELSE 'low' END AS band, list_sort(list_distinct([event_type, event_type, 'k' || (props::JSON->>'k')])) AS parts FROM events")
def d8_d10_json_arrays(spark, sf):
    """Column forms of the JSON operations: map, filter, flatten, dedupe."""
    k = F.get_json_object("props", "$.k")
    parts = F.array_sort(F.array_distinct(F.flatten(F.array(F.array("event_type", "event_type"), F.array(F.concat(F.lit("k"), k))))))
    return table(spark, sf, "events").select("event_id", F.when(k.cast("int") >= 50, "high").otherwise("low").alias("band"), parts.alias("parts"))

"""Full synchronisation of a source: its discovery pages' links become list tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = r'<a href="(/[^"]*)">([^<]*)</a>'


def full_sync(pages: DataFrame, titles: DataFrame, inflight: DataFrame | None) -> DataFrame:
    """url, queue, status, attempts of the new list tasks.

    pages: url, html; titles: title, those of enabled categories. Links with a title that is wanted, whatever its case,
    are taken, resolved against their page's host, each once, without the urls of inflight. Without titles there is no task.
    """
    at = lambda g: F.regexp_extract_all("html", F.lit(LINK), F.lit(g))
    links = pages.select("url", F.explode(F.arrays_zip(at(1).alias("href"), at(2).alias("title"))).alias("l"))
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    found = links.select(F.concat(host, "l.href").alias("url"), F.lower(F.trim("l.title")).alias("title"))
    wanted = titles.select(F.lower(F.trim("title")).alias("title")).distinct()
    new = found.join(wanted, "title", "left_semi").select("url").distinct()
    if inflight is not None:
        new = new.join(inflight.select("url"), "url", "left_anti")
    return new.select("url", F.lit("list").alias("queue"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))

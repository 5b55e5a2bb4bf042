"""Translations by batch with a stored cache, re-syncs that are asked for, tasks put into the queue, availabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalith.operators.answers import known_value
from catalith.operators.enqueue import enqueue, resync_requests, resync_tasks, task_table
from catalith.operators.translation import ORIGINS, batch_stats, cache_table, translate_batch, with_translations
from catalith.plans.define import Plans
from catalith.sources.shared import new_path
from catalith.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

#: Texts of order lines: the order in capitals with blanks around it, the kind of product, its size as a number, and nothing. The dictionary has the orders that are fulfilled, the model doesn't know the products.
ASKED_SQL = """WITH asked AS (SELECT l_orderkey, unnest(['  ORDER ' || l_orderkey, p_name || ' ', ' ' || p_size, NULL]) AS text, ((month(l_shipdate) - 1) // 4)::INTEGER AS batch FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT DISTINCT batch, lower(trim(text)) AS text FROM asked WHERE text IS NOT NULL AND NOT regexp_full_match(trim(text), '[0-9]+')), d AS (SELECT 'order ' || o_orderkey AS text FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT batch, k.text, CASE WHEN d.text IS NOT NULL THEN 'dictionary' WHEN NOT starts_with(k.text, 'order ') THEN 'untranslated' WHEN batch = min(batch) OVER (PARTITION BY k.text) THEN 'llm' ELSE 'cache' END AS origin FROM k LEFT JOIN d ON d.text = k.text)"""


def _translated(spark, sf):
    """Batches of texts, one for each third of the year, what each resolved to, and the cache after them; the second batch is given twice."""
    orders = table(spark, sf, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text"), "o_orderstatus")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    shown = F.array(F.concat(F.lit("  ORDER "), F.col("l_orderkey").cast("string")), F.concat("p_name", F.lit(" ")), F.concat(F.lit(" "), F.col("p_size").cast("string")), F.lit(None).cast("string"))
    asked = table(spark, sf, "lineitem").join(p, "l_partkey").select("l_orderkey", "l_shipdate", F.explode(shown).alias("text"))
    cache = cache_table(spark, new_path(spark, "translation-cache"))
    given = {"languages": ("en", "hu"), "dictionary": orders.filter("o_orderstatus = 'F'").withColumn("translation", F.concat(F.lit("d:"), "text")), "answers": orders.withColumn("translation", F.concat(F.lit("m:"), "text")), "cache": cache}
    third = F.floor((F.month("l_shipdate") - 1) / 4)
    batches, resolved = [asked.filter(third == k) for k in range(3)], []
    for number, rows in enumerate(batches):
        resolved.append(translate_batch(rows, number, now=F.lit(f"2000-01-0{number + 1} 00:00:00").cast("timestamp_ntz"), **given))
    translate_batch(batches[1], 1, now=F.lit("2000-01-02 00:00:00").cast("timestamp_ntz"), **given)
    return batches, resolved, cache


@P.query(f"""{ASKED_SQL} SELECT a.batch, a.given, c.different, c.dictionary, c.cache, c.llm, c.untranslated FROM (SELECT batch, count(*) AS given FROM asked GROUP BY 1) a JOIN
(SELECT batch, count(*) AS different, count(*) FILTER (WHERE origin = 'dictionary') AS dictionary, count(*) FILTER (WHERE origin = 'cache') AS cache, count(*) FILTER (WHERE origin = 'llm') AS llm, count(*) FILTER (WHERE origin = 'untranslated') AS untranslated FROM r GROUP BY 1) c USING (batch)""")
def a25_translation_batches(spark, sf):
    """For each batch of texts how many each origin has translated: what the model answered once comes from the cache later."""
    batches, resolved, _ = _translated(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [batch_stats(t, r).withColumn("batch", F.lit(k)) for k, (t, r) in enumerate(zip(batches, resolved, strict=True))]).select("batch", "given", "different", *ORIGINS)


@P.query(f"{ASKED_SQL} SELECT text, min('m:' || text) AS translation, count(*) FILTER (WHERE origin = 'cache') AS hits, max(batch)::INTEGER + 1 AS day FROM r WHERE origin IN ('llm', 'cache') GROUP BY text")
def x31_translation_cache_rows(spark, sf):
    """The cache after the batches: translations, hits, and the day they were last asked for."""
    return _translated(spark, sf)[2].read().select("text", "translation", "hits", F.dayofmonth("last_accessed").alias("day"))


@P.query(f"""{ASKED_SQL} SELECT l_orderkey, a.text, CASE WHEN a.text IS NULL OR regexp_full_match(trim(a.text), '[0-9]+') THEN trim(a.text) WHEN origin = 'dictionary' THEN 'd:' || r.text WHEN origin = 'untranslated' THEN trim(a.text) ELSE 'm:' || r.text END AS translated
FROM asked a LEFT JOIN r ON r.batch = a.batch AND r.text = lower(trim(a.text))""")
def j19_translated_texts(spark, sf):
    """Every text with its translation, numbers and unknown ones as they are."""
    batches, resolved, _ = _translated(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [with_translations(t.select("l_orderkey", "text"), "text", r, ("en", "hu")) for t, r in zip(batches, resolved, strict=True)])


REQUESTS_SQL = """rec AS (SELECT l_partkey * 100000 + l_suppkey AS record_id, l_partkey AS product_id, CASE WHEN s_acctbal > 0 THEN s_suppkey END AS source_id, CASE WHEN s_nationkey <> 7 THEN 'https://www.shop' || s_suppkey || '.example.com/p/' || l_partkey END AS url
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey),
ask AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id, l_partkey * 100000 + l_suppkey AS record_id, CASE WHEN max(l_tax) < 0.01 THEN l_partkey + 1 ELSE l_partkey END AS product_id, nullif(bool_or(l_returnflag = 'R'), false) AS force
    FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey
  UNION ALL SELECT 'order-' || o_orderkey, -1 - o_orderkey, 1, false FROM orders WHERE o_orderstatus = 'F'),
seen AS (SELECT request_id, ask.product_id, coalesce(force, false) AS force, rec.source_id, rec.url, CASE WHEN rec.record_id IS NULL OR rec.product_id <> ask.product_id THEN 'not found' WHEN source_id IS NULL THEN 'manual source' WHEN url IS NULL THEN 'missing url' ELSE 'queued' END AS outcome FROM ask LEFT JOIN rec USING (record_id))"""


def _checked(spark, sf):
    """Requests for records of large lines, some for another product than the record's, and for records that don't exist."""
    number = F.col("l_partkey") * 100000 + F.col("l_suppkey")
    lines = table(spark, sf, "lineitem")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal", "s_nationkey")
    url = F.format_string("https://www.shop%d.example.com/p/%d", F.col("l_suppkey"), F.col("l_partkey"))
    pairs = lines.select("l_partkey", "l_suppkey").distinct().join(s, "l_suppkey")
    records = pairs.select(number.alias("record_id"), F.col("l_partkey").alias("product_id"), F.when(F.col("s_acctbal") > 0, F.col("l_suppkey")).alias("source_id"), F.when(F.col("s_nationkey") != 7, url).alias("url"))
    large = lines.filter("l_quantity > 30").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_tax").alias("tax"), F.bool_or(F.col("l_returnflag") == "R").alias("back"))
    product = F.when(F.col("tax") < 0.01, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    asked = large.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("request_id"), number.alias("record_id"), product.alias("product_id"), F.when(F.col("back"), True).alias("force"))
    order = F.col("o_orderkey")
    unknown = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("order-"), order.cast("string")).alias("request_id"), (-1 - order).alias("record_id"), F.lit(1).cast("long").alias("product_id"), F.lit(False).alias("force"))
    return resync_requests(asked.unionByName(unknown), records)


@P.query(f"WITH {REQUESTS_SQL} SELECT outcome, count(*) AS n, count(*) FILTER (WHERE force) AS forced, count(DISTINCT source_id) AS sources FROM seen GROUP BY 1")
def t13b_resync_outcomes(spark, sf):
    """What becomes of requests to scrape single records again."""
    return _checked(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("force").alias("forced"), F.count_distinct("source_id").alias("sources"))


@P.query(f"WITH {REQUESTS_SQL} SELECT request_id AS task_id, 'detail' AS queue, 'pending' AS status, source_id, url, product_id, bool_or(force) AS force, 0 AS attempts FROM seen WHERE outcome = 'queued' GROUP BY ALL")
def s21_written_tasks(spark, sf):
    """The queue after the accepted requests in two batches, forced ones first, each given twice."""
    tasks = resync_tasks(_checked(spark, sf))
    queue = task_table(spark, new_path(spark, "tasks"))
    for number, forced in enumerate((True, False)):
        for _ in range(2):
            enqueue(queue, tasks.filter(F.col("force") == forced), number)
    return queue.read()


@P.query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'in_stock' WHEN 'R' THEN 'preorder' END AS availability FROM lineitem")
def f46_known_availability(spark, sf):
    """The availability that an offer states, if it is one of those that exist as it is written; none otherwise."""
    said = F.when(F.col("l_returnflag") == "A", "in_stock").when(F.col("l_returnflag") == "R", "preorder").otherwise("In stock")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", known_value(said, ("in_stock", "out_of_stock", "preorder")).alias("availability"))

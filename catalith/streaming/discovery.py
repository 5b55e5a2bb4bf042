"""Incremental discovery as a stream: found links become tasks, once, and what is known or on its way stays out.

Files of hits are read as they come in. Each micro-batch is made distinct by URL, classified by rules, and held against the records and the tasks that are there; what is new goes into the keyed table of
tasks under the batch's number. So a batch that is run again changes nothing, and a run over a folder without new hits emits nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.text import url_key
from catalith.sources.keyed import KeyedTable

HITS = "source_id long, url string"
TASKS = "key string, url string, source_id long, queue string, status string, number int"
#: A task in one of these is on its way.
UNDER_WAY = ("pending", "processing")


def task_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, path, TASKS, ["key"], buckets)


def classified(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The queue of the first rule (pattern, queue) that the URL meets; null, and no task, without one."""
    return F.coalesce(*[F.when(url.rlike(p), F.lit(q)) for p, q in rules], F.lit(None).cast("string"))


def new_tasks(hits: DataFrame, sources: DataFrame, records: DataFrame, tasks: DataFrame, rules: Sequence[tuple[str, str]], links: bool = False) -> DataFrame:
    """url, key, source_id, queue of the hits (source_id, url) that are to be scraped.

    URLs that are equal without case and closing slashes are one; the least spelling and source count. Left out are hits of sources (source_id, enabled) that aren't enabled or known, of no rule, with a record (url), or with a task
    that is under way. With `links`, as in a full sync, whose hits are pages of links, records don't matter.
    """
    known = hits.filter("url is not null").join(sources.filter("enabled").select("source_id").distinct(), "source_id")
    one = known.withColumn("key", url_key(F.col("url"))).groupBy("key").agg(F.min(F.struct("url", "source_id")).alias("x")).select("key", "x.url", "x.source_id")
    fresh = one.withColumn("queue", classified(F.col("url"), rules)).filter("queue is not null")
    fresh = fresh.join(tasks.filter(F.col("status").isin(*UNDER_WAY)).select("key"), "key", "left_anti")
    return fresh if links else fresh.join(records.select(url_key(F.col("url")).alias("key")).distinct(), "key", "left_anti")


def discover(spark: SparkSession, folder: str, checkpoint: str, target: KeyedTable, sources: DataFrame, records: DataFrame, rules: Sequence[tuple[str, str]], links: bool = False) -> int:
    """Takes in what is new in a folder of Parquet hits, file by file in the order in which they came, and gives the number of tasks that this run has emitted."""
    emitted = 0

    def take(batch: DataFrame, number: int) -> None:
        nonlocal emitted
        fresh = new_tasks(batch, sources, records, target.read(), rules, links).withColumns({"status": F.lit("pending"), "number": F.lit(number)})
        if target.merge(fresh, number):
            emitted += target.read().filter(F.col("number") == number).count()

    stream = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return emitted

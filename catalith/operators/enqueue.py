"""Tasks put into the queue: single records asked for again, and batches of tasks that become pending ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.sources.keyed import KeyedTable

TASKS = "task_id string, queue string, status string, source_id long, url string, product_id long, force boolean, attempts int"
#: What becomes of a request, in the order in which it is looked at.
NOT_FOUND, MANUAL, NO_URL, QUEUED = "not found", "manual source", "missing url", "queued"


def resync_requests(requests: DataFrame, records: DataFrame) -> DataFrame:
    """requests (request_id, record_id, product_id, force) with source_id and url of their record, and `outcome`.

    records: (record_id, product_id, source_id, url), one row for a record. A request is refused if no record has its number, or the record is of another product; if the record was entered by
    hand, without a source; and if it has no url. The others are queued. A request without `force` doesn't force.
    """
    held = records.select("record_id", F.col("product_id").alias("_product"), "source_id", "url")
    both = requests.join(held, "record_id", "left")
    outcome = (
        F.when(F.col("_product").isNull() | ~F.col("_product").eqNullSafe(F.col("product_id")), NOT_FOUND).when(F.col("source_id").isNull(), MANUAL).when(F.coalesce("url", F.lit("")) == "", NO_URL).otherwise(QUEUED)
    )
    return both.withColumn("force", F.coalesce("force", F.lit(False))).withColumn("outcome", outcome).drop("_product")


def resync_tasks(checked: DataFrame) -> DataFrame:
    """Tasks for those of resync_requests() that are queued: product details of the record's url, numbered by their request."""
    queued = checked.filter(F.col("outcome") == QUEUED)
    return queued.select(F.col("request_id").alias("task_id"), F.lit("detail").alias("queue"), "source_id", "url", "product_id", "force")


def task_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """The queue by task_id."""
    return KeyedTable(spark, path, TASKS, ["task_id"], buckets, rules={"attempts": "held.attempts"}, defaults={"attempts": "0"})


def enqueue(queue: KeyedTable, tasks: DataFrame, number: int) -> bool:
    """Saves tasks as pending ones, whatever state they come with; False if the batch was saved before. Attempts of a task that is there already stay."""
    return queue.merge(tasks.withColumn("status", F.lit("pending")), number)

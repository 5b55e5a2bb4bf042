"""Counters and gauges of runs: what passes through a query is counted while it runs, without another pass, and kept as a table of metrics.

Counts come from `observe`: named aggregates that the tasks of the query that writes the result work out on the way. Each run adds its rows to the metrics, in a folder of its own, so a run that is given again
by the same name replaces its rows. Counters add up over runs; of a gauge the last run counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

METRICS = "run string, step string, metric string, kind string, value double, at timestamp"
KINDS = ("counter", "gauge")


class Metrics:
    """The metrics in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def observed(self, rows: DataFrame, step: str, counters: Mapping[str, Column] | None = None, gauges: Mapping[str, Column] | None = None) -> tuple[DataFrame, Measured]:
        """rows, to be written once, and what is counted in them: counters and gauges map names to aggregates."""
        named = {("counter", n): c for n, c in (counters or {}).items()} | {("gauge", n): c for n, c in (gauges or {}).items()}
        seen = Observation(step)
        return rows.observe(seen, *[c.cast("double").alias(f"{kind}:{n}") for (kind, n), c in named.items()]), Measured(self, step, seen)

    def read(self) -> DataFrame:
        """All rows of all runs."""
        return self.spark.read.schema(METRICS).option("recursiveFileLookup", "true").parquet(self.path)

    def totals(self) -> DataFrame:
        """step, metric, kind, value: counters added up over the runs, gauges of the last run (of equal times the greatest name)."""
        rows = self.read()
        counters = rows.filter("kind = 'counter'").groupBy("step", "metric", "kind").agg(F.sum("value").alias("value"))
        return counters.union(rows.filter("kind = 'gauge'").groupBy("step", "metric", "kind").agg(F.max_by("value", F.struct("at", "run")).alias("value")))

    def text(self) -> DataFrame:
        """The totals as lines of the text format that scrapers of metrics read, one row for each line."""
        line = F.concat("metric", F.when(F.col("kind") == "counter", "_total").otherwise(""), F.lit('{step="'), "step", F.lit('"} '), F.regexp_replace(F.col("value").cast("decimal(30,6)").cast("string"), r"\.?0+$", ""))
        return self.totals().select(line.alias("line"))


class Measured:
    """What one write counts; its values are there when the write is over."""

    def __init__(self, metrics: Metrics, step: str, seen: Observation) -> None:
        self.metrics, self.step, self.seen = metrics, step, seen

    def keep(self, run: str, at: str) -> dict[str, float]:
        """Adds the values to the metrics as those of that run, at that time, and gives them. Aggregates over no rows that have no value are 0."""
        got = {k: 0.0 if v is None else float(v) for k, v in self.seen.get.items()}
        rows = [(run, self.step, name.partition(":")[2], name.partition(":")[0], value, at) for name, value in got.items()]
        df = self.metrics.spark.createDataFrame(rows, METRICS.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.metrics.path}/step={self.step}/run={run}")
        return {name.partition(":")[2]: value for name, value in got.items()}

"""Merging one product's specs from many sources: plausibility, corroboration, precision, recency, priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote(candidates: DataFrame, ranges: DataFrame) -> DataFrame:
    """The winning value of each (model_id, key).

    candidates: model_id, key, value (string; a list as a JSON array), last_updated, priority, tie. ranges: key, low, high of
    plausible numbers, and if there is such a column, allowed: an array of values. A single candidate wins unchecked. Of several the
    plausible ones count, or all if none is. Values are grouped by lower case without white space, lists by their items in any order; the largest groups stay; among tied groups of numbers one with more decimals wins if
    all others are its roundings; then the latest, then the greatest priority, then the least tie.
    """
    number = F.col("value").try_cast("double")
    rows = candidates.join(ranges, "key", "left").withColumn("number", number)
    plain = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    # a bound that isn't given holds nothing off; a value that is no number fails any bound that is
    bounded = F.col("low").isNotNull() | F.col("high").isNotNull()
    inside = F.coalesce(F.col("number") >= F.col("low"), F.col("low").isNull()) & F.coalesce(F.col("number") <= F.col("high"), F.col("high").isNull())
    plausible = ~bounded | (F.col("number").isNotNull() & inside)
    if "allowed" in ranges.columns:
        plausible &= F.col("allowed").isNull() | F.exists("allowed", lambda x: plain(x) == plain(F.col("value")))
    own = Window.partitionBy("model_id", "key")
    rows = rows.withColumn("plausible", plausible).withColumn("some", F.max(F.col("plausible").cast("int")).over(own)).withColumn("n", F.count("*").over(own))
    rows = rows.filter((F.col("n") == 1) | (F.col("some") == 0) | F.col("plausible"))
    items = F.array_sort(F.transform(F.from_json("value", "array<string>"), plain))
    rows = rows.withColumn("group", F.when(F.startswith(F.ltrim("value"), F.lit("[")) & items.isNotNull(), F.array_join(items, "|")).otherwise(plain(F.col("value"))))
    newest = F.struct(F.col("last_updated"), F.col("priority"), (-F.col("tie")).alias("t"))
    groups = rows.groupBy("model_id", "key", "group").agg(F.count("*").alias("votes"), F.max_by("value", newest).alias("value"), F.max(newest).alias("newest"), F.max("number").alias("number"))
    groups = groups.withColumn("most", F.max("votes").over(own)).filter("votes = most")
    decimals = F.length(F.regexp_extract("value", r"\.(\d+)\s*$", 1))
    groups = groups.withColumn("decimals", decimals).withColumn("finest", F.max(F.struct("decimals", "number")).over(own)).withColumn("rivals", F.count_if(F.col("decimals") == F.col("finest.decimals")).over(own))
    off = F.abs(F.col("number") - F.col("finest.number")) > 0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + 1e-9
    groups = groups.withColumn("off", F.count_if(off | F.col("number").isNull()).over(own))
    precise = (F.col("rivals") == 1) & (F.col("off") == 0) & (F.col("decimals") == F.col("finest.decimals"))
    order = Window.partitionBy("model_id", "key").orderBy(precise.desc(), F.desc("newest"))
    return groups.withColumn("place", F.row_number().over(order)).filter("place = 1").select("model_id", "key", "value", "votes")


def identity(records: DataFrame, fields: list[str]) -> DataFrame:
    """model_id and the agreed value of each identity field of its source records (model_id, last_updated, priority, tie, fields).

    For each field the value that most records have, compared in lower case without outer blanks, wins; of values with equally many, the one whose newest
    record is the latest, then of greater priority, then of lesser tie. Its spelling is that of its newest record. Null and empty values don't count; a field without
    any is null.
    """
    row = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
    cells = records.select("model_id", "last_updated", "priority", (-F.col("tie")).alias("t"), F.explode(F.array(*map(row, fields))).alias("c"))
    cells = cells.select("model_id", "last_updated", "priority", "t", "c.field", "c.value").filter("trim(value) <> ''")
    newest = F.struct("last_updated", "priority", "t")
    groups = cells.groupBy("model_id", "field", F.lower(F.trim("value")).alias("same")).agg(F.count("*").alias("votes"), F.max(newest).alias("newest"), F.max_by("value", newest).alias("value"))
    won = groups.groupBy("model_id", "field").agg(F.max_by("value", F.struct("votes", "newest")).alias("value"))
    named = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return records.select("model_id").distinct().join(won.groupBy("model_id").agg(*named), "model_id", "left")

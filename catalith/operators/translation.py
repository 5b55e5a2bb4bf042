"""Translation of batches of texts: a dictionary first, then a stored cache, then the answers of a model, each asked only for what is left.

Texts are told apart in lower case and without outer white space; numbers carry no language and are left alone. The cache is a keyed table, so a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.text import SPACES, trimmed
from catalith.sources.keyed import KeyedTable
from catalith.sources.shared import written

#: Where a translation may come from, in the order in which they are asked.
ORIGINS = ("dictionary", "cache", "llm", "untranslated")
CACHE = "source_language string, target_language string, text string, translation string, model string, hits long, last_accessed timestamp_ntz, expires_at timestamp_ntz"


def key_of(text: Column) -> Column:
    """What a text is looked up by."""
    return trimmed(F.lower(text))


def is_number(text: Column) -> Column:
    """Digits with signs, white space, points and commas only."""
    return text.rlike(f"^[-+]?({SPACES}|[0-9.,])+$") & text.rlike("[0-9]")


def cache_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """The cache, by languages and text. A translation that is stored anew starts without hits; a hit leaves it as it is."""
    fresh = "if(new.translation is null, {0}, new.{1})"
    rules = {c: fresh.format(f"held.{c}", c) for c in ("translation", "model", "expires_at")} | {"hits": fresh.format("held.hits + 1", "hits")}
    return KeyedTable(spark, path, CACHE, ["source_language", "target_language", "text"], buckets, rules=rules)


def distinct_keys(texts: DataFrame) -> DataFrame:
    """`text`: every lookup key of texts (text) once; null, empty and numeric ones have none."""
    return texts.select(key_of(F.col("text")).alias("text")).filter((F.col("text") != "") & ~is_number(F.col("text"))).distinct()


def resolve(texts: DataFrame, languages: tuple[str, str], dictionary: DataFrame, cache: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """text, translation, origin (one of ORIGINS) of every lookup key of texts (text).

    dictionary: (text, translation), text in the form of a lookup key; cache: rows of CACHE, of which those that have expired by `now` don't count; answers: (text, translation) as a model gave
    them, of which the first by translation counts. Equal languages need no translation: there are no rows then.
    """
    keys = distinct_keys(texts)
    if languages[0] == languages[1]:
        keys = keys.limit(0)
    source, target = languages
    live = (F.col("source_language") == source) & (F.col("target_language") == target) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    found = keys.join(dictionary.groupBy("text").agg(F.min("translation").alias("dictionary")), "text", "left")
    found = found.join(cache.filter(live).select("text", F.col("translation").alias("cache")), "text", "left")
    found = found.join(answers.groupBy("text").agg(F.min("translation").alias("llm")), "text", "left")
    origin = F.lit(ORIGINS[-1])
    for name in reversed(ORIGINS[:-1]):
        origin = F.when(F.col(name).isNotNull(), name).otherwise(origin)
    return found.select("text", F.coalesce(*ORIGINS[:-1]).alias("translation"), origin.alias("origin"))


def batch_stats(texts: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: texts given, different ones among them, and how many of these each origin has answered."""
    asked = texts.agg(F.count("*").alias("given"))
    told = distinct_keys(texts).agg(F.count("*").alias("different"))
    counts = resolved.agg(*[F.count_if(F.col("origin") == o).alias(o) for o in ORIGINS])
    return asked.join(told, F.lit(True)).join(counts, F.lit(True))  # one row each


def with_translations(rows: DataFrame, column: str, resolved: DataFrame, languages: tuple[str, str]) -> DataFrame:
    """rows with `translated`: the text without outer white space, in the other language where a translation is known; null stays null."""
    plain = trimmed(F.col(column))
    if languages[0] == languages[1]:
        return rows.withColumn("translated", plain)
    known = resolved.select(F.col("text").alias("_key"), F.col("translation").alias("_translation"))
    joined = rows.withColumn("_key", key_of(F.col(column))).join(known, "_key", "left")
    return joined.withColumn("translated", F.when(is_number(plain), plain).otherwise(F.coalesce("_translation", plain))).drop("_key", "_translation")


def translate_batch(
    texts: DataFrame, number: int, languages: tuple[str, str], dictionary: DataFrame, cache: KeyedTable, answers: DataFrame, now: Column, model: str = "model", ttl_days: int | None = None, enabled: bool = True
) -> DataFrame:
    """resolve() for batch `number`, written; the cache then has the model's answers of the batch and a hit more for each text that it answered.

    Not enabled, the model is not asked. Without ttl_days answers never expire.
    """
    resolved = written(resolve(texts, languages, dictionary, cache.read(), answers if enabled else answers.limit(0), now), "translations")
    new = F.col("origin") == "llm"
    expires = F.when(new, now + F.make_dt_interval(days=F.lit(ttl_days))) if ttl_days else F.lit(None).cast("timestamp_ntz")
    changes = resolved.filter(new | (F.col("origin") == "cache")).select(
        F.lit(languages[0]).alias("source_language"), F.lit(languages[1]).alias("target_language"), "text", F.when(new, F.col("translation")).alias("translation"), F.when(new, F.lit(model)).alias("model"),
        F.lit(0).cast("long").alias("hits"), now.alias("last_accessed"), expires.alias("expires_at"),
    )
    cache.merge(changes, number)
    return resolved

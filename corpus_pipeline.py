"""The corpus pipeline: toxicity, language ID, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import language_id, packing, toxicity
from catalith.llm.common import stored, table
from catalith.llm.near_dedup import near_duplicates


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, fitted on the labels of sf_dir, scores below 0.5."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that have a language by filters learned from the rows themselves, with this language as their `lang`: only `und` ones, without a letter, go.

    A text that shares nothing with any learned language keeps the `lang` that it came with.
    """
    return language_id.keep_known(docs, language_id.fit(docs.filter(~language_id.held_out())), scored=False, lang_col="lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: the one with the smallest doc_id. Rows with a null id stay.

    A row is its id and its text: one id may stand on several texts, each of which is linked, kept or dropped as that
    text is. A 64-bit hash of both stands for them, and rows equal in both are one.
    """
    row = "_row" + "_" * max(map(len, docs.columns))  # longer than any column of docs
    rows = docs.filter(F.col("doc_id").isNotNull()).withColumn(row, F.xxhash64("doc_id", "text"))
    found = near_duplicates(rows, threshold=80, id_col=row).select(F.col("doc_id").alias(row), "component_id").distinct()
    kept = rows.select(row, "doc_id").join(found, row).groupBy("component_id").agg(F.min(F.struct("doc_id", row))[row].alias(row))
    one = rows.join(kept, row, "left_semi").dropDuplicates(["doc_id", row]).drop(row)
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left; each bin is of one language, as the language stage found it."""
    return packing.pack_documents(docs, by="lang")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_bins),
]

#: Learned stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

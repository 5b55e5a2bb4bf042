"""Similarity join of names by trigrams, with the prefix filter of set joins.

Two sets with overlap (intersection over union) of at least t share one of the rarest n - ceil(t * n) + 1 trigrams of either, so only those
are exploded and equi-joined; candidates are then verified on all trigrams. Equal names are one row until the end, and blocking keys are
part of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.similarity import overlap, trigrams


def _prefixes(names: DataFrame, keys: list[str], grams: list[str], least: float) -> DataFrame:
    """keys, the columns of names and one row for each of the rarest trigrams in the block of which a similar name must have one."""
    every = names.select("*", F.explode("grams").alias("gram"))
    counts = every.groupBy(*keys, "gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy(*keys, *grams).orderBy("df", "gram")
    ranked = every.join(counts, [*keys, "gram"]).withColumn("place", F.row_number().over(order))
    n = F.size("grams")
    return ranked.filter(F.col("place") <= n - F.ceil(F.lit(least) * n - 1e-9) + 1).select(*keys, *grams, "gram", n.alias("n"))


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    both = pairs.join(left.select(*keys, "a", F.col("grams").alias("x")), [*keys, "a"]).join(right.select(*keys, "b", F.col("grams").alias("y")), [*keys, "b"])
    return both.withColumn("similarity", overlap(F.col("x"), F.col("y"))).filter(F.col("similarity") >= least).select(*keys, "a", "b", "similarity")


def _sizes(least: float):
    return F.expr(f"least(n, m) >= {least} * greatest(n, m) - 1e-9")


def similar_names(names: DataFrame, keys: list[str], name: str, least: float) -> DataFrame:
    """keys, a, b, similarity of each pair of different names a < b of one block with similarity of at least `least`."""
    distinct = names.select(*keys, name).distinct().withColumn("grams", trigrams(F.col(name)))
    prefix = _prefixes(distinct, keys, [name], least)
    left, right = prefix.withColumnRenamed(name, "a"), prefix.withColumnRenamed(name, "b").withColumnRenamed("n", "m")
    pairs = left.join(right, [*keys, "gram"]).filter("a < b").filter(_sizes(least)).select(*keys, "a", "b").distinct()
    return _verified(pairs, distinct.withColumnRenamed(name, "a"), distinct.withColumnRenamed(name, "b"), keys, least)


def similar_across(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, a, b, similarity of each a of left and b of right of one block with similarity of at least `least`, equal names too.

    left has keys and a, right keys and b; either may repeat rows. Names without a trigram are like none.
    """
    x, y = left.select(*keys, "a").distinct().withColumn("grams", trigrams(F.col("a"))), right.select(*keys, "b").distinct().withColumn("grams", trigrams(F.col("b")))
    named = lambda df, c, side: df.select(*keys, F.col(c).alias("name"), "grams", F.lit(side).alias("side"))
    prefix = _prefixes(named(x, "a", 0).union(named(y, "b", 1)), keys, ["name", "side"], least)
    a = prefix.filter("side = 0").select(*keys, F.col("name").alias("a"), "gram", "n")
    b = prefix.filter("side = 1").select(*keys, F.col("name").alias("b"), "gram", F.col("n").alias("m"))
    return _verified(a.join(b, [*keys, "gram"]).filter(_sizes(least)).select(*keys, "a", "b").distinct(), x, y, keys, least)

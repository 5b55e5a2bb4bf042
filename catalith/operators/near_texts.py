"""Near-duplicate texts: equal, one within the other, or alike by letter pairs; and a text within a longer one up to small edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.text import edit_ratio, normalised, trimmed, without_punctuation

#: Characters of the grams by which a text is looked up in others.
GRAM = 4


def _grams(x: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n))))


def near_texts(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """(a, b), a < b: ids of rows (id, text) whose normalised texts are equal, hold one another, or have a Dice coefficient of letter pairs of `least`.

    Candidates come from equi-joins only. A text that is within another one shares its rarest gram with it. Two texts with a Dice
    coefficient of d share one of the rarest of their pairs, counted with repeats, as no more than n - ceil(n * d / (2 - d)) of either's n can be alone.
    Equal texts are one row until the end. Empty texts are near to one another only; null ones to none.
    """
    texts = rows.select("id", normalised(F.col("text")).alias("t")).filter("t is not null")
    distinct = texts.select("t").distinct()
    long = distinct.filter(F.length("t") > 0)
    few = long.filter(F.length("t") < GRAM)

    grams = long.select("t", F.explode(_grams(F.col("t"), GRAM)).alias("g"))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    rarest = grams.filter(F.length("t") >= GRAM).join(df, "g").groupBy(F.col("t").alias("x")).agg(F.min(F.struct("df", "g")).alias("r")).select("x", F.col("r.g").alias("g"))
    held = rarest.join(grams.withColumnRenamed("t", "y"), "g").filter("x <> y and contains(y, x)").select("x", "y")
    # shorter texts than a gram are looked up whole among the pieces of their own length
    pieces = long.select("t", F.explode(F.flatten(F.array(*[_grams(F.col("t"), n) for n in range(1, GRAM)]))).alias("x")).withColumnRenamed("t", "y")
    held = held.union(few.withColumnRenamed("t", "x").join(pieces, "x").filter("x <> y").select("x", "y"))

    bare = F.regexp_replace("t", r"\s+", "")
    plain = long.select("t", bare.alias("p")).filter(F.length("p") > 1)
    pairs = plain.select("t", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 1), lambda i: F.substring(F.col("p"), i, F.lit(2)))).alias("pair"))
    counted = pairs.groupBy("t", "pair").agg(F.count("*").alias("n")).select("t", "pair", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    often = counted.groupBy("pair", "k").agg(F.count("*").alias("df"))
    own, order = Window.partitionBy("t"), Window.partitionBy("t").orderBy("df", "pair", "k")
    ranked = counted.join(often, ["pair", "k"]).withColumns({"place": F.row_number().over(order), "n": F.count("*").over(own)})
    prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least / (2 - least) - 1e-9) + 1)
    left, right = prefix.select(F.col("t").alias("x"), "pair", "k", "n"), prefix.select(F.col("t").alias("y"), "pair", "k", F.col("n").alias("m"))
    alike = left.join(right, ["pair", "k"]).filter(F.expr(f"x < y and 2 * least(n, m) >= {least} * (n + m) - 1e-9")).select("x", "y").distinct()
    first, second = counted.select(F.col("t").alias("x"), "pair", "k"), counted.select(F.col("t").alias("y"), "pair", "k")
    common = alike.join(first, "x").join(second, ["y", "pair", "k"]).groupBy("x", "y").agg(F.count("*").alias("common"))
    sizes = counted.groupBy("t").agg(F.count("*").alias("n"))
    alike = common.join(sizes.withColumnRenamed("t", "x"), "x").join(sizes.select(F.col("t").alias("y"), F.col("n").alias("m")), "y").filter(2 * F.col("common") >= least * (F.col("n") + F.col("m")) - 1e-9).select("x", "y")
    same = plain.select(F.col("t").alias("x"), "p").join(plain.select(F.col("t").alias("y"), "p"), "p").filter("x < y").select("x", "y")

    near = held.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).union(alike).union(same).union(distinct.select(F.col("t").alias("x"), F.col("t").alias("y"))).distinct()
    both = near.join(texts.select(F.col("id").alias("i"), F.col("t").alias("x")), "x").join(texts.select(F.col("id").alias("j"), F.col("t").alias("y")), "y").filter("i <> j and (x <> y or i < j)")
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def window_ratio(text: Column, source: Column) -> Column:
    """The best edit ratio of text with a part of source that begins at a word and has 0.8 to 1.2 times its length; with all of a shorter source."""
    n, m = F.length(text), F.length(source)
    low, high = F.greatest(F.lit(1), F.floor(n * 0.8).cast("int")), F.least(m, F.ceil(n * 1.2).cast("int"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: (i == 1) | (F.substring(source, i - 1, F.lit(1)) == " "))
    ratio = lambda i, k: edit_ratio(text, F.substring(source, i, k))
    best = F.array_max(F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.sequence(low, F.greatest(low, high)), lambda k: (i + k - 1 <= m) & (k <= high)), lambda k: ratio(i, k)))))
    return F.when(n > m, edit_ratio(text, source)).otherwise(F.coalesce(best, F.lit(0.0)))


def contains_near(longer: Column, shorter: Column, least: float = 0.85, most_length: float = 0.75) -> Column:
    """Whether a text of at most most_length of the longer one's length stands in it as it is or with a window_ratio() of `least`, case and punctuation apart."""
    plain = lambda x: without_punctuation(F.lower(trimmed(x)))
    x, y = plain(longer), plain(shorter)
    fits = (F.length(x) > 0) & (F.length(y) > 0) & (F.length(y) < F.length(x)) & (F.length(y) / F.length(x) <= most_length)
    return F.coalesce(F.when(fits, F.contains(x, y) | (window_ratio(y, x) >= least)), F.lit(False))

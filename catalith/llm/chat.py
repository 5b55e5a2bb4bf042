"""Chat formatting: cumulative-snapshot collapse, then rendering. DataFrame functions only.

Services log a conversation anew after each turn, so many logged conversations are the beginning of a longer one. Every
turn gets the hash of the conversation up to it: the exclusive or, over the turns so far, of hashes of place, role and
text, in two independent 64-bit halves. A conversation whose last hash is some other conversation's inner hash begins
that one and goes; of equal conversations the smallest id stays. The anti-join compares distinct hashes, so a first turn
or a conversation that is logged a million times is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is written; roles are lower-cased, and a null role or text is written as empty.
OPEN, CLOSE, BETWEEN = "<|", "|>\n", "\n"


def _halves(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), p1, p2 (hash of the turns up to this one), n_turns, for each distinct turn."""
    # equal rows are one turn; the text itself isn't moved, its hash is
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    null = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("digest"), null.alias("nulls")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest", "nulls")
    rows = rows.withColumn("place", F.row_number().over(order)).select("conv_id", "place", *_halves(F.col("place"), F.col("role"), F.col("digest"), F.col("nulls")))
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("conv_id", "place", F.bit_xor("h1").over(so_far).alias("p1"), F.bit_xor("h2").over(so_far).alias("p2"), F.max("place").over(whole).alias("n_turns"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that begin no longer one; of equal ones the smallest conv_id."""
    hashes = prefix_hashes(turns)
    key = ["place", "p1", "p2"]
    last = hashes.filter("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.filter("place < n_turns").select(*key).distinct()
    return last.join(inner, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of the kept conversations."""
    head = F.concat(F.lit(OPEN), F.lower(F.coalesce("role", F.lit(""))), F.lit(CLOSE))
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    rows = turns.filter("conv_id is not null").join(kept, "conv_id", "left_semi")
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), digest.alias("digest"), F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string")).alias("nulls"), F.concat(head, F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("said"))
    # one conversation's turns make one string, so they meet in one row
    both = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    return both.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["said"]), BETWEEN).alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of every maximal conversation of turns (conv_id, turn, role, text).

    Turns come by number, a null one first, then by role and digest of the text. Equal rows are one turn. A null role or
    text is written as empty but is not equal to an empty one. Turns with a null conv_id belong to no conversation and
    are left out. An empty table gives an empty result; other columns are ignored.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return render(turns, maximal(turns))

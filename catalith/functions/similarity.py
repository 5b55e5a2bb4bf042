"""Similarity of strings and vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before it and one after it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the multisets of letter pairs, blanks left out; a pair counts as often as both strings have it."""
    plain = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    pairs = lambda x: F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))
    x, y = plain(a), plain(b)
    p, q = pairs(x), pairs(y)
    count = lambda arr, v: F.size(F.filter(arr, lambda e: e == v))
    common = F.aggregate(F.array_intersect(p, q), F.lit(0), lambda s, v: s + F.least(count(p, v), count(q, v)))
    return F.when(x == y, 1.0).when((F.size(p) == 0) | (F.size(q) == 0), 0.0).otherwise(2.0 * common / (F.size(p) + F.size(q)))


def prefix_words(a: Column, b: Column) -> Column:
    """Share of the longer name's words that begin alike, from the first word on."""
    x, y = F.split(F.lower(F.trim(a)), r"\s+"), F.split(F.lower(F.trim(b)), r"\s+")
    hit = F.zip_with(x, y, lambda u, v: F.coalesce(u.startswith(v) | v.startswith(u), F.lit(False)))
    run = F.aggregate(hit, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, h: F.struct((s["on"] & h).alias("on"), (s["n"] + F.when(s["on"] & h, 1).otherwise(0)).alias("n")))
    return run["n"] / F.greatest(F.size(x), F.size(y))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

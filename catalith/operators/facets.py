"""Faceted counts in one pass over the products.

Each filter is a boolean column. A multi-select facet counts the rows that pass every other filter than its own, so that
its unchosen options stay visible; boolean and range facets count the rows that pass all filters, their own included.
Every row is exploded once into one row for each facet that it counts for, and one aggregate makes all facets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facet:
    """kind is `multi`, `boolean`, `range` or `buckets`; predicate is the filter in force on the facet's own key, or None."""

    key: str
    kind: str
    value: Column
    predicate: Column | None = None
    buckets: tuple[tuple[str, float, float], ...] = ()


def _all(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in predicates], F.lit(True))


def passes(facets: list[Facet], other: list[Column]) -> Column:
    """Whether a row passes every filter."""
    return _all(other + [f.predicate for f in facets if f.predicate is not None])


def count(rows: DataFrame, facets: list[Facet], other: list[Column] = ()) -> DataFrame:
    """key, value, n, low, high: a row for each option of a multi-select or bucket facet, one for each boolean and range.

    n counts rows with the option; for a boolean facet value is `true` and n the rows where it holds; for a range n counts
    rows with a number, low and high are its ends. Null and empty options are left out.
    """
    parts = []
    for f in facets:
        others = [g.predicate for g in facets if g.predicate is not None and (g is not f or f.kind not in ("multi", "buckets"))]
        ok = _all(list(other) + others)
        number = f.value.try_cast("double")
        if f.kind == "multi":
            option, size = f.value.cast("string"), F.lit(None).cast("double")
        elif f.kind == "boolean":
            option, size = F.when(f.value.try_cast("boolean"), F.lit("true")), F.lit(None).cast("double")
        elif f.kind == "range":
            option, size = F.when(number.isNotNull(), F.lit("range")), number
        else:
            option = F.coalesce(*[F.when(number.between(low, high), F.lit(name)) for name, low, high in f.buckets])
            size = F.lit(None).cast("double")
        parts.append(F.when(ok & option.isNotNull() & (option != ""), F.struct(F.lit(f.key).alias("key"), option.alias("value"), size.alias("size"))))
    hits = rows.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("hit")).select("hit.*")
    return hits.groupBy("key", "value").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))

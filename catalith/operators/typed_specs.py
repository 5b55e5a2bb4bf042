"""Specs as typed columns: JSON documents are parsed once, when the table is written, and filters and facets read columns.

A declared key becomes a column of its type, `spec_<key>`, by way of VARIANT: numbers as double, booleans, strings, and lists of strings. A value that isn't of the type is null there. The whole document stays as
VARIANT in `specs` for keys that nobody declared. Rows are written in order of a few columns, so that filters which Parquet is given skip row groups by their ends.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.facets import Facet

TYPES = {"number": "double", "boolean": "boolean", "string": "string", "list": "array<string>"}


def with_columns(rows: DataFrame, keys: Mapping[str, str], specs: str = "specs") -> DataFrame:
    """rows with a column for each declared key (name -> number, boolean, string or list) in place of a JSON text; the text becomes VARIANT. A text that isn't JSON is null."""
    held = rows.withColumn(specs, F.try_parse_json(specs))
    read = {f"spec_{k}": F.try_variant_get(F.col(specs), f"$.{k}", TYPES[kind]) for k, kind in keys.items()}
    numbers = {c: F.when(F.isnan(read[c]) | (F.abs(read[c]) == float("inf")), None).otherwise(read[c]) for c in read if keys[c[5:]] == "number"}
    return held.withColumns(read | numbers)


@dataclass(frozen=True)
class TypedSpecs:
    """A written table with spec columns; `keys` names the types."""

    spark: SparkSession
    path: str
    keys: Mapping[str, str]

    def write(self, rows: DataFrame, order: list[str], specs: str = "specs") -> TypedSpecs:
        with_columns(rows, self.keys, specs).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def is_(self, key: str, value: str | float | bool) -> Column:
        """The key has the value; a text is read as the key's type, and for a list the value is one of its items."""
        kind, column = self.keys[key], F.col(f"spec_{key}")
        if kind == "list":
            return F.array_contains(column, str(value))
        if kind == "boolean":
            return column == (value if isinstance(value, bool) else str(value).lower() == "true")
        if kind == "number":
            number = re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", str(value))
            return column == float(value) if number else F.lit(False)
        return column == str(value)

    def between(self, key: str, low: float | None, high: float | None) -> Column:
        """A number from low to high, both counted; an open end is None. With both open nothing is asked for."""
        column = F.col(f"spec_{key}")
        found = F.lit(True) if low is None else column >= float(low)
        return found if high is None else found & (column <= float(high))

    def among(self, key: str, text: str) -> Column:
        """`3,10-20,-2,40-`: values and ranges with either end open, any of them; an item that isn't a range of numbers is a value. An empty text asks for nothing."""
        found = []
        for item in filter(None, (x.strip() for x in text.split(","))):
            ends = re.fullmatch(r"(\d+(?:\.\d+)?)?-(\d+(?:\.\d+)?)?", item) if self.keys[key] == "number" and item != "-" else None
            found.append(self.between(key, *ends.groups()) if ends else self.is_(key, item))
        return reduce(lambda a, b: a | b, found) if found else F.lit(True)

    def facet(self, key: str, kind: str, predicate: Column | None = None, buckets: tuple = ()) -> Facet:
        return Facet(key, kind, F.col(f"spec_{key}"), predicate, buckets)

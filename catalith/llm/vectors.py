"""What the operators on vectors of integers share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held between -LIMIT and LIMIT, so that squared distances of up to 512 components fit in 63 bits.
LIMIT = 1 << 26
MOST = 2**63 - 1


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as int; null for a vector that is null or has a null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    held = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, held))


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """The rows of a list column whose lists all have `width` values."""
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel(), kind))


def total(column: str) -> Column:
    """The sum of a long column, exact, held at the greatest long."""
    return F.least(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(MOST).cast("decimal(30,0)")).cast("long")


def with_group_total(rows: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """rows with the sum of `column` over all rows of equal `key`, nulls together.

    The sums are made with map-side combining and joined back, so that a key with many rows isn't gathered anywhere;
    the join's large keys are split by the adaptive execution.
    """
    sums = rows.groupBy(F.col(key).alias("_key")).agg(total(column).alias(name))
    return rows.join(sums, rows[key].eqNullSafe(sums["_key"])).drop("_key")

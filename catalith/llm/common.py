"""What the operators share: table reading, tables cut from their lineage, and flat views of Arrow text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.sources.shared import shared_dir  # noqa: F401
from catalith.sources.shared import written as stored  # noqa: F401

#: Most bytes of text and most rows that a task turns into numpy arrays at a time.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(docs: DataFrame, per_run: int, most: int = 512) -> Column:
    """Column: a number that cuts docs (doc_id long, tie long) into runs of about per_run rows and never falls in ascending (doc_id, tie).

    At most `most` quantiles of the ids, which an aggregate finds, are the borders; between two of them ids are cut evenly. So
    ids may have any values and gaps, and no run has many more rows than a `most`-th of the table unless these are equal
    in id and tie. Null ids come first. Rows of a border's own id, which may be many, and null ids are cut by tie.
    """
    at = [k / most for k in range(most)]
    found = docs.agg(F.count("doc_id").alias("n"), F.count("*").alias("all"), F.max("doc_id").alias("last"), F.percentile_approx("doc_id", at, 20_000).alias("knots")).first()
    n = found["n"]
    blank = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * (k := max(1, (found["all"] - n) // per_run))), F.lit(k - 1)) - k
    if not n:
        return blank
    count = min(most, max(1, n // per_run))
    times = Counter(found["knots"][k * most // count] for k in range(count))
    parts = max(1, n // count // per_run)
    # a border that is several quantiles at once has that many runs for its own rows, cut by tie; then come the ids up to the next border
    own = [t * parts if t > 1 else 0 for _, t in sorted(times.items())]
    base = [sum(own[:k]) + k * parts for k in range(len(own))]
    knots = F.lit(sorted(times))
    place = F.aggregate(F.lit([1 << k for k in range(most.bit_length(), -1, -1)]), F.lit(-1), lambda at, step: F.when(F.get(knots, at + step) <= F.col("doc_id"), at + step).otherwise(at))
    low, high = F.get(knots, place).cast("double"), F.coalesce(F.get(knots, place + 1), F.lit(found["last"])).cast("double")
    cut = lambda share, into: F.least(F.greatest(F.floor(share * into), F.lit(0)), into - 1)
    mine = F.get(F.lit(own), place)
    same = (F.col("doc_id") == F.get(knots, place)) & (mine > 0)
    share = F.coalesce((F.col("doc_id").cast("double") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    inside = F.when(same, cut(F.col("tie") / 2.0**64 + 0.5, mine)).otherwise(mine + cut(share, F.lit(parts)))
    return F.when(F.col("doc_id").isNull(), blank).otherwise(F.get(F.lit(base), place) + inside).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS rows and about SLICE_BYTES of `column` (a longer text is alone)."""
    for batch in batches:
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values one after the other, and the offsets of each value; null counts as empty."""
    column = column.cast(pa.string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return held, ends - (ends[0] if len(ends) else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _STEP modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        for k, step in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            factors = np.full(max(n, SLICE_BYTES + 65_536), step, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair of places, from one running sum."""
    return run_hashes(_BYTE[data], start, end)


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the run values[start:end] of 64-bit values for each pair of places, from one running sum."""
    up, down = _power(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

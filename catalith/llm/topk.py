"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks of rows.

A term is a vector position, its posting list the rows of a block with a non-zero weight there, in ascending id. For a
query every non-zero weight scatters weight * posting weights into a dense array with one score for each row of the
block; the k best of the array are selected by partition, with all ties at the border resolved by the smaller id, and
the blocks' lists are merged. Rows and queries are dealt into blocks of bounded size by hash of id and weights, and one task holds one block of
rows and one of queries, so memory doesn't grow with either table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and queries of a block, about; and the fewest blocks of rows, so that small tables spread too.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_BLOCKS = 8192, 4096, 48
SCALE = 256


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of every component as long; null for a vector that is null or has a null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("long")))


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions and values of the non-zero weights of a list column."""
    column = column.combine_chunks()
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.values, dtype=np.int64)[offsets[0] : offsets[-1]]
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), counts)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = values != 0
    return rows[keep], terms[keep], values[keep]


def _most(rows: np.ndarray, values: np.ndarray, n: int) -> float:
    """The greatest sum of a row's absolute weights."""
    return float(np.bincount(rows, np.abs(values.astype(np.float64)), n).max(initial=0.0))


def _search(k: int):
    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries, right: the rows of a block."""
        ids = right.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        right, ids = right.take(pa.array(order)), ids[order]
        rows, terms, values = _matrix(right.column("weights"))
        by = np.argsort(terms, kind="stable")
        rows, terms, values = rows[by], terms[by], values[by]
        starts = np.searchsorted(terms, np.arange(terms[-1] + 2 if len(terms) else 1))
        queries = left.column("vec_id").to_numpy()
        q_rows, q_terms, q_values = _matrix(left.column("weights"))
        q_starts = np.searchsorted(q_rows, np.arange(len(queries) + 1))
        # scores that may leave 63 bits are added up exactly
        wide = _most(rows, values, len(ids)) * _most(q_rows, q_values, len(queries)) >= 2.0**62
        if wide:
            values, q_values = values.astype(object), q_values.astype(object)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, own in enumerate(queries):
            scores = np.zeros(len(ids), object if wide else np.int64)
            for t, w in zip(q_terms[q_starts[q] : q_starts[q + 1]], q_values[q_starts[q] : q_starts[q + 1]], strict=True):
                if t < len(starts) - 1:
                    held = slice(starts[t], starts[t + 1])
                    scores[rows[held]] += w * values[held]  # a row is in a posting list once
            if wide:
                scores = np.array([max(-(2**63), min(2**63 - 1, x)) for x in scores], np.int64)
            others = np.flatnonzero(ids != own)
            found = scores[others]
            if len(found) > k:
                border = np.partition(found, len(found) - k)[len(found) - k]
                above = np.flatnonzero(found > border)
                best = np.concatenate([above, np.flatnonzero(found == border)[: k - len(above)]])
            else:
                best = np.arange(len(found))
            out.append((np.full(len(best), own), ids[others[best]], found[best]))
        merged = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table([pa.array(x, pa.int64()) for x in merged], ["query_id", "vec_id", "score"])

    return block


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows for every query: query_id, rank, vec_id, score, ties to the smaller vec_id.

    Both tables have vec_id long and weights array<long>. A row with the query's own vec_id is no candidate. Rows with a
    null id or null weights take no part. Rows that share an id are candidates each, as they are queries each; a query id
    gets the k best scores of all its rows. Vectors may differ in length: missing positions weigh nothing. A score beyond
    63 bits counts as the greatest or least such number. Fewer candidates than k give fewer rows; an empty table gives an
    empty result.
    """
    known = lambda df: df.filter("vec_id is not null and weights is not null").groupBy("vec_id", "weights").agg(F.count("*").alias("n"))
    # of rows that are equal in id and weights, and so in score, no more than k can be among the k best
    clean = lambda df: known(df).select("vec_id", "weights", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)))).alias("n")).drop("n")
    rows, queries = clean(rows), clean(queries)
    n, m = rows.count(), queries.count()
    blocks, parts = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    pair = lambda df, own, count, other, rest: df.withColumn(own, F.pmod(F.xxhash64("vec_id", "weights"), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(rest - 1))))
    left, right = pair(queries, "part", parts, "block", blocks), pair(rows, "block", blocks, "part", parts)
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best other rows for each row whose vec_id is divisible by `every`, over all quantised vectors."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("weights"))
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)

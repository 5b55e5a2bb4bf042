"""Lloyd's rounds over integer vectors with Drake's adaptive bounds.

Every vector keeps a number of its nearest other centroids, each with a lower bound of its distance, in ascending order,
and one lower bound of all the rest. When centroids move, a bound falls by its centroid's own drift and that of the rest by the greatest
drift, while the distance to the vector's own centroid grows by no more than that one's drift. If the distance, made exact where the
drifted one isn't enough, is less than the bounds from some place of the list on, only the centroids before that place
are compared; if it isn't less than the bound of the rest, all are. So a vector is compared anew exactly when its order can't be
certified. Comparisons are of exact integers, ties go to the smaller number, and a bound certifies only what is strictly less.
The number of bounds adapts: the next round keeps no more than this round had use for, an eighth of the centroids at least.

A round is one pass over the vectors' table, which has their bounds beside them and is written to the shared folder; the new centroids are
sums with map-side combining. The centroids (k rows) go to the tasks, nothing else does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import stored
from catalith.llm.vectors import MOST, integers, lists, matrix

#: Rows that a task has as matrices at a time.
ROWS = 4096
#: What floating point may have lost in a bound, as a share of it.
SLACK = 1e-12
STATE = "vec_id long, v array<int>, cluster int, upper double, near array<int>, lower array<double>, rest double, used int"


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v from the rows of c beside them, or from the one row c."""
    return ((v - c) ** 2).sum(axis=-1)


def _scan(v: np.ndarray, centroids: np.ndarray, bounds: int) -> tuple[np.ndarray, ...]:
    """Cluster, distance, near, lower and rest of rows that are compared with all centroids."""
    k = len(centroids)
    d = np.stack([_squares(v, c) for c in centroids], axis=1)
    order = np.argsort(d, axis=1, kind="stable")
    sorted_ = np.sqrt(np.take_along_axis(d, order, axis=1)) * (1 - SLACK)
    rest = sorted_[:, bounds + 1] if bounds + 1 < k else np.full(len(v), np.inf)
    own = order[:, 0]
    return own, d[np.arange(len(v)), own], order[:, 1 : bounds + 1], sorted_[:, 1 : bounds + 1], rest


def first_assignment(centroids: np.ndarray, bounds: int):
    """The pass that compares every vector with every centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = matrix(part.column("v"), centroids.shape[1])
                yield _batch(part, *_scan(v, centroids, bounds), np.full(len(v), bounds))

    return run


def _batch(part: pa.RecordBatch, own, d, near, lower, rest, used) -> pa.RecordBatch:
    columns = [part.column("vec_id"), part.column("v"), pa.array(own, pa.int32()), pa.array(np.sqrt(d) * (1 + SLACK)), lists(near, pa.int32()), lists(lower, pa.float64()), pa.array(rest, pa.float64()), pa.array(used, pa.int32())]
    return pa.record_batch(columns, [c.split()[0] for c in STATE.split(", ")])


def reassign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, old: np.ndarray, new: np.ndarray, bounds: int) -> tuple[np.ndarray, ...]:
    """The assignment of rows to the centroids that moved from old to new, with `bounds` bounds a row: own, the square of the
    upper bound, near, lower, rest, and the place in the list up to which bounds were of use (beyond the list: all compared)."""
    n, held = near.shape
    drift = np.sqrt(_squares(new, old)) * (1 + SLACK)
    upper = (upper + drift[own]) * (1 + SLACK)
    lower = lower - drift[near] - SLACK * lower
    rest = rest - drift.max() - SLACK * np.where(np.isfinite(rest), rest, 0)
    # what_follows[:, i]: no centroid of the list from place i on, nor of the rest, is nearer than this
    what_follows = np.minimum.accumulate(np.concatenate([rest[:, None], lower[:, ::-1]], axis=1), axis=1)[:, ::-1]
    square = upper * upper
    open_ = np.flatnonzero(upper >= what_follows[:, 0])
    exact = _squares(v[open_], new[own[open_]])
    square[open_] = exact
    tight = np.sqrt(exact) * (1 + SLACK)
    place = (tight[:, None] >= what_follows[open_]).sum(axis=1)  # bounds ascend from place to place, so the failing ones come first
    used = np.zeros(n, np.int64)
    used[open_] = place
    own, near, lower = own.copy(), near.copy(), lower.copy()
    for m in range(1, held + 1):
        rows = open_[place == m]
        if not len(rows):
            continue
        some = np.concatenate([own[rows, None], near[rows, :m]], axis=1)
        d = np.stack([_squares(v[rows], new[some[:, j]]) for j in range(m + 1)], axis=1)
        order = np.lexsort((some, d), axis=1)
        some, d = np.take_along_axis(some, order, axis=1), np.take_along_axis(d, order, axis=1)
        own[rows], square[rows] = some[:, 0], d[:, 0]
        near[rows, :m], lower[rows, :m] = some[:, 1:], np.sqrt(d[:, 1:]) * (1 - SLACK)
    if bounds < held:
        rest = np.minimum(rest, lower[:, bounds:].min(axis=1))
        near, lower = near[:, :bounds], lower[:, :bounds]
    full = open_[place == held + 1]
    if len(full):
        own[full], square[full], near[full], lower[full], rest[full] = _scan(v[full], new, bounds)
    return own, square, near, lower, rest, used


def next_assignment(old: np.ndarray, new: np.ndarray, held: int, bounds: int):
    """The pass after the centroids moved; the state has `held` bounds a row, its successor `bounds`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                col = lambda c, p=part: np.asarray(p.column(c))
                yield _batch(part, *reassign(matrix(part.column("v"), old.shape[1]), col("cluster").astype(np.int64), col("upper"), matrix(part.column("near"), held), matrix(part.column("lower"), held, np.float64), col("rest"), old, new, bounds))

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d = _squares(matrix(part.column("v"), centroids.shape[1]), centroids[np.asarray(part.column("cluster"))])
                yield pa.record_batch([part.column("vec_id"), part.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at floor(sum / count) of its vectors, component by component; those without vectors stay."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]) for i in range(centroids.shape[1])])
    out = centroids.copy()
    for cluster, n, *parts in sums.collect():  # k rows
        out[cluster] = [x // n for x in parts]
    return out


def cluster_vectors(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors are kept that have `dims` components, none null or non-finite; component x becomes floor(scale * x), held within
    2**26. Centroids start as the k vectors with the least lowercase-hex sha256 of "seed:vec_id", equal ids by their components;
    vectors with a null id are assigned but start no centroid, and with fewer vectors there are fewer centroids. After `rounds` rounds of assigning and moving vectors are assigned once
    more. Sums beyond 63 bits count as the greatest such number. Repeated rows count each; no kept vector with an id gives an empty result; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("v"))
    rows = stored(rows.filter((F.size("v") == dims) & F.col("v").isNotNull()), "vectors")
    named = rows.filter("vec_id is not null").withColumn("name", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = [r["v"] for r in named.orderBy("name", "v").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array(first, np.int64)
    least = max(1, len(centroids) // 8)
    bounds = held = min(len(centroids) - 1, max(least, -(-len(centroids) // 4)))
    state = stored(rows.mapInArrow(first_assignment(centroids, bounds), STATE), "assigned")
    for _ in range(rounds):
        old, centroids = centroids, moved(state, centroids)
        state = stored(state.mapInArrow(next_assignment(old, centroids, held, bounds), STATE), "assigned")
        held = bounds
        used = state.agg(F.max(F.when(F.col("used") <= held, F.col("used")))).first()[0]
        bounds = min(held, max(least, used or 0))
    found = stored(state.mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long"), "distances")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # k rows
    inertia = min(MOST, sum(int(r["s"]) for r in sums))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(r["cluster"], min(MOST, int(r["s"])), inertia, digest(centroids[r["cluster"]])) for r in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows

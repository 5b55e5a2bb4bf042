"""Vectors as short codes: product quantisation whose codebooks are fitted by Lloyd's rounds with Yinyang's group filter.

A vector is cut into equal parts, each of which has a codebook. The entries of a codebook are put into groups of near ones once, before
the rounds. For every part a vector keeps an upper bound of the distance to its entry, and for every group a lower bound of the distance to the
group's entries other than its own. When entries move, the upper bound grows by the own entry's drift and a group's bound
falls by the greatest drift in the group. Only groups whose bound isn't above the upper bound, made exact first, are scanned. Scans compare exact integers, so ties are
settled by index; bounds are rounded away from what they bound, so an equal distance never passes a filter.

Each round is one pass over the vectors' table, which has codes and bounds beside the components and is written to the shared folder; new entries are
sums with map-side combining. Codebooks and groups (parts * entries rows) go to the tasks, nothing else does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.common import stored
from catalith.llm.vectors import integers, lists, matrix, with_group_total

#: Rows that a task has as matrices at a time.
ROWS = 4096
#: Entries for each group, about.
GROUP = 10
_F = np.float32


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(_F), _F(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(_F), _F(np.inf))


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((v - c) ** 2).sum(axis=-1)


def entry_groups(entries: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """A group number for every entry: a few Lloyd rounds from seeds far from one another. Any grouping gives right codes."""
    seeds = [0]
    while len(seeds) < count:
        seeds.append(int(np.argmax(np.min([_squares(entries, entries[s]) for s in seeds], axis=0))))
    centres = entries[seeds].astype(np.float64)
    for _ in range(rounds):
        group = np.argmin([((entries - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres = np.array([entries[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(count)])
    return group


def assign_part(v: np.ndarray, entries: np.ndarray, members: list[np.ndarray], group: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper bound and group bounds of one part's rows, from code and bounds that are adjusted by the drifts."""
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    rows = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    if not len(rows):
        return code, upper, lower
    was = code[rows]
    own = _squares(v[rows], entries[was])
    tight = _up(np.sqrt(own))
    fails = lower[rows] <= tight[:, None]
    best, found = own.copy(), was.copy()
    scanned = []
    for g, some in enumerate(members):
        at = np.flatnonzero(fails[:, g])
        if not len(at) or not len(some):
            continue
        d = np.stack([_squares(v[rows[at]], entries[e]) for e in some], axis=1)
        first = d.argmin(axis=1)  # of equal ones that of the lower index
        one = d[np.arange(len(at)), first]
        two = np.partition(d, 1, axis=1)[:, 1] if len(some) > 1 else np.full(len(at), np.inf)
        nearer = (one < best[at]) | (one == best[at]) & (some[first] < found[at])
        best[at[nearer]], found[at[nearer]] = one[nearer], some[first[nearer]]
        scanned.append((g, at, some[first], one, two))
    # the old entry is an other one now, in a group that may not have been scanned
    changed = np.flatnonzero(found != was)
    low = lower[rows]
    low[changed, group[was[changed]]] = np.minimum(low[changed, group[was[changed]]], _down(np.sqrt(own[changed])))
    for g, at, entry, one, two in scanned:
        low[at, g] = _down(np.sqrt(np.where(entry == found[at], two, one)))
    code[rows], upper[rows], lower[rows] = found, _up(np.sqrt(best)), low
    return code, upper, lower


def _pass(schema: T.StructType, old: np.ndarray | None, new: np.ndarray, groups: np.ndarray, count: int):
    """One assignment of all parts; old None: the first one, in which every group is scanned."""
    parts, entries, width = new.shape
    members = [[np.flatnonzero(groups[p] == g) for g in range(count)] for p in range(parts)]
    drift = np.zeros((parts, entries)) if old is None else np.sqrt(_squares(new, old)) * (1 + 1e-12)
    fall = np.array([[drift[p, m].max(initial=0.0) for m in members[p]] for p in range(parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = batch.num_rows
                v = matrix(batch.column("v"), parts * width).reshape(n, parts, width)
                if old is None:
                    code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf, _F), np.full((n, parts, count), -np.inf, _F)
                else:
                    code = matrix(batch.column("code"), parts)
                    upper = _up(matrix(batch.column("upper"), parts, np.float64) + drift[np.arange(parts), code])
                    lower = _down(matrix(batch.column("lower"), parts * count, np.float64).reshape(n, parts, count) - fall)
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    code[:, p], upper[:, p], lower[:, p] = assign_part(v[:, p], new[p], members[p], groups[p], code[:, p], upper[:, p], lower[:, p])
                    error += _squares(v[:, p], new[p][code[:, p]])
                columns = {"code": lists(code, pa.int32()), "upper": lists(upper, pa.float32()), "lower": lists(lower.reshape(n, -1), pa.float32()), "error": pa.array(error)}
                yield pa.record_batch([columns[f.name] if f.name in columns else batch.column(f.name) for f in schema], schema.names)

    return run


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at floor(sum / count) of its parts, component by component; those without parts stay."""
    width = books.shape[2]
    rows = state.select("v", F.posexplode("code").alias("part", "entry"))
    sums = rows.groupBy("part", "entry").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.col("part") * width + i)) for i in range(width)])
    out = books.copy()
    for part, entry, n, *values in sums.collect():  # parts * entries rows
        out[part, entry] = [x // n for x in values]
    return out


def fit_codes(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, v, code array<int>, error) of every kept vector, and the codebooks (parts x entries x components).

    Dropped are vectors that are null or have a null or non-finite component, and those whose length isn't the most frequent one
    that `parts` divides (of equally frequent ones the greatest). Component x becomes floor(scale * x), held within 2**26. Codebooks start as the parts
    of the vectors of least id, equal ids by their components; vectors with a null id have codes but start no entry, and with
    fewer vectors there are fewer entries. Repeated rows count each; other columns are ignored. An empty table gives an empty table and no entries.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), integers(F.col(vector_col), scale).alias("v"))
    rows = stored(rows.filter("v is not null"), "vectors")
    size = F.size("v")
    length = rows.filter((size > 0) & (size % parts == 0)).groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.filter(size == (length["size"] if length else -1))
    first = [r["v"] for r in rows.filter("vec_id is not null").orderBy("vec_id", "v").limit(entries).collect()]
    array = lambda kind: T.ArrayType(kind)
    added = [("code", array(T.IntegerType())), ("upper", array(T.FloatType())), ("lower", array(T.FloatType())), ("error", T.LongType())]
    schema = T.StructType(rows.schema.fields + [T.StructField(*x) for x in added])
    if not first:
        return rows.sparkSession.createDataFrame([], schema).drop("upper", "lower"), np.empty((parts, 0, 0), np.int64)
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    count = max(1, len(first) // GROUP)
    groups = np.array([entry_groups(b, count) for b in books])
    state = stored(rows.mapInArrow(_pass(schema, None, books, groups, count), schema), "codes")
    for _ in range(rounds):
        old, books = books, moved(state, books)
        state = stored(state.mapInArrow(_pass(schema, old, books, groups, count), schema), "codes")
    return state.drop("upper", "lower"), books


def compress(embeddings: DataFrame, **kw) -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256; see fit_codes."""
    state, books = fit_codes(embeddings, **kw)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = state.select("vec_id", "label", code.alias("code"), "error")
    return with_group_total(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

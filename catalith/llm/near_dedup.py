"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

A text's sketch has one coordinate per bin. In round i every shingle is hashed, with a seed of that round, to one
bin; a bin that was empty keeps the least hash that falls in it. Rounds go on until no bin is empty; after as many
rounds as there are bins, round T + j puts every shingle into bin j, so that every bin fills for any non-empty set.
Two texts agree in a coordinate with the probability of their Jaccard similarity, and the number of agreements is
concentrated as for independent coordinates. The time is that of the set plus T log T, not their product.

Bands of coordinates give candidate buckets. Texts with the same shingle set are one class before banding. Inside a
bucket no all-pairs list is made. First every member is held against one head, that of most of its buckets (a star);
the links that stand are joined into components. Members of buckets that still hold several components are held against one
head of another component. What is open after that goes to an exact prefix filter. Sets that are like a common head are
a cluster, and are compared by what sets them apart from the cluster's core, the shingles that most of its members
have: two of them that are linked must share some of these differences, or be light enough to be linked with the lightest
one anyway. So an equi-join on the rarest differences of either finds every pair, and members that have only the core in
common, as form letters of different people have, are never paired. Sets of different clusters are compared likewise by all of their shingles. A
shingle's rows of its largest component are joined with those of other components only. Every pair that counts as a
link is verified on the full shingle sets. Links inside a component are not needed, as they cannot change it; no link
between components is skipped.

Chance to miss a link of just the threshold in all bands: below MISS (2.4e-7 at 85 %, 3e-6 at 80 %); the four-bit sketches
are compared five standard deviations below their mean, which adds 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import flat_text, mix, shared_dir, slices, span_hashes, stored

SHINGLE_WORDS = 5
BINS = 384
#: Greatest chance that a link of just the threshold is in no common bucket.
MISS = 1e-5
#: Bits of a coordinate that the small sketch keeps, and its 64-bit words.
SIGN_BITS = 4
SIGN_WORDS = BINS * SIGN_BITS // 64
_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_SHINGLE = [_U(int(x) | 1) for x in _RANDOM.integers(0, 2**63, SHINGLE_WORDS, dtype=_U)]
_SEED = _RANDOM.integers(0, 2**64, 2 * BINS, dtype=_U)
_COLUMN = _RANDOM.integers(0, 2**63, BINS, dtype=_U) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NONE = _U(2**64 - 1)

def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ordered by text and then hash: their text numbers and the hashes."""
    size = len(data)
    if not size:
        return np.empty(0, np.int64), np.empty(0, _U)
    word = ~_SPACE[data]
    before = np.empty(size, bool)
    before[0], before[1:] = False, word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    start = np.flatnonzero(word & ~before)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, _U)
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, word[1:]
    after[first[1:] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    words = span_hashes(_LOWER[data], start, end)
    doc = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.cumsum(count) - count
    n = len(words)
    full = np.zeros(n, _U)
    for j in range(SHINGLE_WORDS):
        full[: max(0, n - j)] += words[j:] * _SHINGLE[j]
    at = np.arange(n) - place[doc]
    keep = at + SHINGLE_WORDS <= count[doc]
    docs, hashes = [doc[keep]], [full[keep]]
    for k in range(1, SHINGLE_WORDS):
        few = np.flatnonzero(count == k)
        if len(few):
            docs.append(few)
            hashes.append(sum(words[place[few] + j] * _SHINGLE[j] for j in range(k)) + _U(k))
    docs, hashes = np.concatenate(docs), mix(np.concatenate(hashes))
    order = np.argsort(hashes)
    order = order[np.argsort(docs[order].astype(np.uint16 if len(offsets) <= 65_536 else np.int64), kind="stable")]
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def sketches(docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The n x BINS coordinates. Rows of empty sets keep the greatest number everywhere."""
    out = np.full((n, BINS), _NONE, _U)
    ids = np.unique(docs)
    for i in range(2 * BINS):
        if not len(ids):
            break
        h = mix(hashes ^ _SEED[i])
        bins = ((h >> _U(32)) * _U(BINS)) >> _U(32) if i < BINS else np.full(len(h), i - BINS, _U)
        value = (h << _U(32)) | (h >> _U(32))
        value -= (value == _NONE).astype(_U)
        row = np.searchsorted(ids, docs)
        least = np.full(len(ids) * BINS, _NONE, _U)
        np.minimum.at(least, row * BINS + bins.astype(np.int64), value)
        least = least.reshape(len(ids), BINS)
        have = out[ids]
        have = np.where(have == _NONE, least, have)
        out[ids] = have
        open_ = (have == _NONE).any(axis=1)
        if not open_.all():
            keep = open_[row]
            docs, hashes, ids = docs[keep], hashes[keep], ids[open_]
    return out


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sign array<long>"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64).ravel())


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), _signed(x))


def banding(threshold: int) -> tuple[int, int]:
    """Bands and rows of a band: as many rows as MISS allows at threshold %."""
    shapes = [(BINS // rows, rows) for rows in range(1, 17)]
    return max(((bands, rows) for bands, rows in shapes if (1 - (threshold / 100) ** rows) ** bands <= MISS), key=lambda x: x[1], default=(BINS, 1))


def _sketcher(bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = batch.num_rows
            docs, hashes = shingle_sets(*flat_text(batch.column("text")))
            count = np.bincount(docs, minlength=n)
            keys = []
            for seed in _SEED[:2]:
                total = np.zeros(n, _U)
                np.add.at(total, docs, mix(hashes + seed))
                keys.append(total)
            out = sketches(docs, hashes, n)
            buckets = mix((out * _COLUMN)[:, : bands * rows].reshape(n, bands, rows).sum(axis=2, dtype=_U) + _SEED[:bands])
            bits = (mix(out) >> _U(64 - SIGN_BITS)).astype(np.uint8)
            planes = [np.packbits(bits >> k & 1, axis=1).view(_U) for k in range(SIGN_BITS)]
            sign = np.stack(planes, axis=2).reshape(n, SIGN_WORDS)
            yield pa.record_batch([batch.column("doc_id"), pa.array(count), _signed(keys[0]), _signed(keys[1]), _lists(buckets), _lists(sign)], ["doc_id", "n_shingles", "k1", "k2", "bands", "sign"])

    return sketch


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        docs, hashes = shingle_sets(*flat_text(batch.column("text")))
        ends = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=batch.num_rows))]).astype(np.int32)
        yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), _signed(hashes))], ["id", "words"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges (a, b): the least vertex that it can reach.

    Alternates the large-star and small-star steps until the edges are stars. Each step is an aggregate with map-side
    combining and a join; nothing is gathered by vertex. Edges with a null end, or from a vertex to itself, count not.
    """
    shared_dir(edges.sparkSession)
    held = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    before = None
    while True:
        both = held.union(held.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        pairs = large.join(small, large["a"] == small["u"])
        held = pairs.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct().checkpoint()
        now = held.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return held.select(F.col("a").alias("id"), F.col("b").alias("component")).union(held.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now


def _signed_columns(prefix: str) -> list:
    """n_shingles and the sketch's words as columns prefix_n, prefix_0 ..; as plain numbers the join's code stays small enough to be compiled."""
    return [F.coalesce("n_shingles", F.lit(0)).alias(f"{prefix}_n"), *[F.coalesce(F.col("sign")[i], F.lit(0)).alias(f"{prefix}_{i}") for i in range(SIGN_WORDS)]]


def _agree(threshold: int) -> str:
    """SQL: sizes and four-bit sketches of the two sides l and r allow a similarity of threshold %.

    Word SIGN_BITS * i + k of a sketch holds bit k of 64 coordinates, so a coordinate differs if any of SIGN_BITS bits does.
    """
    j = threshold / 100
    mean = j + (1 - j) / 2**SIGN_BITS
    least = BINS * mean - 5 * (BINS * mean * (1 - mean)) ** 0.5
    differ = " + ".join("bit_count(" + " | ".join(f"(l_{i} ^ r_{i})" for i in range(w, w + SIGN_BITS)) + ")" for w in range(0, SIGN_WORDS, SIGN_BITS))
    return f"100 * least(l_n, r_n) >= {threshold} * greatest(l_n, r_n) and {differ} <= {int(BINS - least)}"


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have threshold % of their union in common."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.filter(F.col("common") * 100 >= threshold * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def _heads(open_: DataFrame) -> DataFrame:
    """(a, b): each id of open_ (id, head) once, with the head that stands in most of its rows."""
    votes = open_.groupBy("id", "head").agg(F.count("*").alias("n"))
    return votes.groupBy(F.col("id").alias("a")).agg(F.max_by("head", F.struct("n", "head")).alias("b"))


def _weight(size: Column, n: Column, threshold: int) -> Column:
    """s of a set of n shingles with `size` differences from a core: x and y are linked if and only if their differences
    have at least (s(x) + s(y)) / (2 * (100 + threshold)) in common. Without a core the shingles themselves are the differences."""
    return (100 + threshold) * size - (100 - threshold) * n


def _rare_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b) with every linked pair of rows (id, part, n, d, s, least) of different parts whose s add up to more than 0.

    d holds the differences, n the number of shingles, s is _weight(), least a lower bound of s for partners with a smaller s.
    Of d in any order that is the same for all, the first size(d) - k + 1 share one with a partner that has k in common. Rare ones come first.
    """
    unit = 100 + threshold
    held = rows.select("id", "part", "n", "s", "least", F.size("d").alias("size"), F.explode("d").alias("w"))
    often = held.groupBy("w").agg(F.count("*").alias("often"))
    order = Window.partitionBy("id").orderBy("often", "w")
    first = lambda s: F.col("size") - F.greatest(F.lit(1), F.ceil(s / (2 * unit))) + 1
    entries = held.join(often, "w").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= first(F.col("s") + F.least("least", "s")))
    entries = stored(entries.drop("often", "least"), "entries")
    # differences in the prefixes of the same sets find the same pairs: one of them stands for all, at the first one's place
    alike = entries.groupBy("w").agg(F.count("*").alias("often"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40))).alias("y"))
    alike = alike.filter("often > 1").select("w", F.xxhash64("often", "x", "y").alias("key"))
    keyed = entries.join(alike, "w").groupBy("key", "id", "part", "n", "s", "size").agg(F.min("place").alias("place"))
    tops = keyed.groupBy("key", "part").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("part", F.struct("k", "part")).alias("top"), F.count("*").alias("k"))
    marked = stored(keyed.join(tops.filter("k > 1").drop("k"), "key"), "marked")
    light = marked.filter(F.col("place") <= first(2 * F.col("s")))
    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "part", "n", "s", "size", "place")])
    fits = F.expr(
        f"l_part <> r_part and (l_s < r_s or l_s = r_s and l_id < r_id) and l_s + r_s > 0 and 100 * least(l_n, r_n) >= {threshold} * greatest(l_n, r_n)"
        f" and 2 * {unit} * (1 + least(l_size - l_place, r_size - r_place)) >= l_s + r_s"
    )
    other, top = F.col("part") != F.col("top"), F.col("part") == F.col("top")
    pairs = [side(a, "l").join(side(b, "r"), "key").filter(fits) for a, b in ((light.filter(other), marked), (light.filter(top), marked.filter(other)))]
    return pairs[0].union(pairs[1]).select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()


def _open_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b) that links all sets (id, component, cluster, words) which any links between different components join."""
    n = F.size("words").cast("long")
    apart = rows.select("id", F.col("cluster").alias("part"), n.alias("n"), F.col("words").alias("d"), _weight(n, n, threshold).alias("s"), F.ceil(2 * threshold * threshold * n / 100).alias("least"))

    sizes = rows.groupBy("cluster").agg(F.count("*").alias("members")).filter("members > 1")
    counts = rows.select("cluster", F.explode("words").alias("w")).groupBy("cluster", "w").agg(F.count("*").alias("k"))
    cores = counts.join(sizes, "cluster").filter("2 * k > members").groupBy("cluster").agg(F.collect_list("w").alias("core"))  # at most twice the mean set
    both = rows.join(sizes.select("cluster"), "cluster").join(cores, "cluster", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    own = lambda x, sign: F.transform(x, lambda w: F.xxhash64("cluster", w, F.lit(sign)))
    d = F.concat(own(F.array_except("words", "core"), 1), own(F.array_except("core", "words"), 0))
    deltas = both.select("id", "component", "cluster", n.alias("n"), d.alias("d")).withColumn("s", _weight(F.size("d").cast("long"), F.col("n"), threshold))
    lightest = deltas.groupBy("cluster").agg(F.min(F.struct("s", "id")).alias("x")).select("cluster", F.col("x.s").alias("least"), F.col("x.id").alias("b"))
    deltas = stored(deltas.join(lightest, "cluster"), "deltas")
    light = deltas.filter("s + least <= 0 and id <> b").select(F.col("id").alias("a"), "b")
    inside = _rare_pairs(deltas.select("id", F.col("component").alias("part"), "n", "d", "s", "least"), threshold)
    return light.union(inside).union(_rare_pairs(apart, threshold)).distinct()


def near_duplicates(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than space and tab to carriage return, with A-Z lower-cased. A text's set holds
    its distinct five-word shingles, with fewer words its whole word sequence; two texts link if 100 * intersection >=
    threshold * union. Null and empty texts and texts without words have an empty set and link with nothing. Repeated
    rows give repeated results; ids are expected to be unique to a text, and one id with several texts gives a row for
    each, linked as that text is. A null id takes no part
    and has component null and kept true. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = stored(docs.mapInArrow(_sketcher(*banding(threshold)), SKETCH), "sketch")
    linkable = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(linkable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("class_id")), "classes")

    firsts = classes.select(F.col("class_id").alias("doc_id"), "k1", "k2")
    reps = linkable.join(firsts, ["doc_id", "k1", "k2"], "left_semi")
    rows = stored(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")), "bands")
    stars = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("head")).filter("least <> most")
    members = stored(rows.join(stars.select("bucket", "head"), "bucket"), "members")

    ids = members.select("id").distinct()
    nodes = stored(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sign").join(ids, "id", "left_semi"), "nodes")
    texts = docs.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi")
    sets = stored(texts.mapInArrow(_sets, "id long, words array<long>"), "sets")
    near = _agree(threshold)

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be links by their sketches."""
        both = pairs.join(nodes.select(F.col("id").alias("a"), *_signed_columns("l")), "a").join(nodes.select(F.col("id").alias("b"), *_signed_columns("r")), "b").filter(near).select("a", "b")
        return stored(both.distinct(), "likely")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        return stored(_verified(pairs, sets, threshold).distinct(), "links")

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """labels (id, component) with the components of linked ids made one."""
        ends = links.join(labels.select(F.col("id").alias("a"), F.col("component").alias("u")), "a").join(labels.select(F.col("id").alias("b"), F.col("component").alias("v")), "b")
        one = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b")))
        found = labels.join(one.select(F.col("id").alias("component"), F.col("component").alias("_one")), "component", "left")
        return stored(found.select("id", F.coalesce("_one", "component").alias("component")), "labels")

    first = likely(_heads(members.filter("id <> head").select("id", "head")))
    labels = stored(ids.join(components(linked(first)), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")

    # buckets with several components: their largest component's head, and what isn't of that component
    held = members.drop("head").join(labels, "id")
    inside = held.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(1)), "id"))["id"].alias("head"))
    split = inside.groupBy("bucket").agg(F.max_by(F.struct("head", F.col("component").alias("top")), F.struct("n", "component")).alias("x"), F.count("*").alias("k")).filter("k > 1").select("bucket", "x.*")
    open_ = stored(held.join(split, "bucket"), "open")
    second = likely(_heads(open_.filter("component <> top").select("id", "head")))
    labels = joined(labels, linked(second))

    held = open_.select("bucket", "id").join(labels, "id")
    still = held.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("bucket")
    rest = stored(held.join(still, "bucket", "left_semi").select("id", "component").distinct(), "open")
    some = lambda pairs: pairs.join(rest.select(F.col("id").alias("a")), "a", "left_semi").join(rest.select(F.col("id").alias("b")), "b", "left_semi")
    clusters = joined(rest, some(first.union(second))).withColumnRenamed("component", "cluster")
    rest = stored(sets.join(rest.join(clusters, "id"), "id"), "rest")
    labels = joined(labels, linked(likely(_open_pairs(rest, threshold))))

    least = labels.groupBy("component").agg(F.min("id").alias("_least"))
    labels = labels.join(least, "component").select("id", F.col("_least").alias("component"))
    by_class = classes.join(labels, classes["class_id"] == labels["id"], "left").select("k1", "k2", "n_shingles", F.coalesce("component", "class_id").alias("component"))
    linked_rows = linkable.select("doc_id", "k1", "k2", "n_shingles").join(by_class, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "component")
    free = sk.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = linked_rows.unionByName(free).withColumnRenamed("component", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

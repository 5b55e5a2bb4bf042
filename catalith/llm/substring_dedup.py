"""Repeated passages by relative Lempel-Ziv parsing, removed word by word.

A word goes if a window of WINDOW words that covers it stands at some other place too. Documents are not held against all
reference blocks, as that grows with the square of the corpus; every window is routed to the one block that can have its copies:

1. The key of a window is the least hash of its short word runs, so equal windows have equal keys wherever they stand. Consecutive windows
   of one key are a region (at most REGION windows). One row for each region, about one for sixteen words, has its key, a hash of its words and its place.
2. Keys that stand once have no copies. Where all regions of a key are the same words, they are copies whole. What is left are keys
   with different regions; one of each goes on with its text, with the number of its copies.
3. These regions are the reference, dealt by key into blocks of bounded size. A block's regions are indexed by suffix order, and each region is factored greedily against
   the block: at a place the longest run that stands at another place of the block is the factor. A factor of WINDOW words or more is a
   duplicate span. A window that lies in no such factor crosses a factor's end, so parsing goes on with the windows that
   cross it, and not behind it.
4. Keys with over DEEP different regions, such as the edges of a passage that many documents quote in different surroundings, are
   split by window: their windows are counted with map-side combining, so no block has to hold such a key.
5. Spans go back to all places of their regions and then to the documents.

Nothing is gathered by key but a block's at most DEEP regions of it, or by document but what is as long as the document.
Words, regions and windows are compared by 64-bit hashes, regions and split windows within one key, that is by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import flat_text, mix, run_hashes, slices, span_hashes, stored

WINDOW = 35
#: Words of the runs whose least hash is a window's key, and most windows of a region.
RUN, REGION = 5, 64
#: Most different regions of a key that are factored in one block; words of a block, about, and the fewest blocks.
DEEP, BLOCK_WORDS, LEAST_BLOCKS = 256, 200_000, 48
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEYS = ["k1", "k2"]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in data of every word of the texts that lie one after the other in data, and the number of words before each text."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling; one for each place at which so many follow."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def regions(data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The regions of all texts: text number, key, hash of the words, first word, windows, bytes from and to, occurrences of the key."""
    start, end, place = word_bounds(data, offsets)
    run = min(RUN, window)
    words = span_hashes(data, start, end)
    if len(words) < window:
        return {c: np.empty(0, np.int64) for c in ("text", "key", "words", "first", "n", "low", "high", "weight")}
    at = np.arange(len(words) - run + 1)
    hashes = run_hashes(words, at, at + run)
    keys = _least(hashes, window - run + 1)
    text = np.searchsorted(place, np.arange(len(keys)), side="right") - 1
    whole = np.flatnonzero(np.arange(len(keys)) + window <= place[text + 1])  # windows that end in the text in which they begin
    keys, text = keys[whole], text[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (np.diff(whole) > 1) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    inside = np.arange(len(whole)) - np.repeat(first, np.diff(np.append(first, len(whole))))
    first = np.flatnonzero(inside % REGION == 0)
    n = np.diff(np.append(first, len(whole)))
    at = whole[first]
    span = n + window - run  # runs in the region
    ends = np.cumsum(span)
    same = hashes[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - span - at, span)] == np.repeat(keys[first], span)
    last = at + n + window - 1
    return {
        "text": text[first], "key": keys[first].view(np.int64), "words": run_hashes(words, at, last).view(np.int64), "first": at - place[text[first]], "n": n,
        "low": start[at] - offsets[text[first]], "high": end[last - 1] - offsets[text[first]], "weight": np.add.reduceat(same, ends - span) if len(ends) else n,
    }


REGIONS = "k1 long, k2 long, key long, words long, first int, n int, low int, high int, weight int"


def _regions(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = regions(*flat_text(batch.column("text")), window)
            own = [batch.column(c).take(pa.array(found["text"])) for c in _KEYS]
            rest = [pa.array(found[c], pa.int64() if c in ("key", "words") else pa.int32()) for c in ("key", "words", "first", "n", "low", "high", "weight")]
            yield pa.record_batch([*own, *rest], [c.split()[0] for c in REGIONS.split(", ")])

    return run


TEXTS = "key long, words long, copies long, deep boolean, block long, text binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The regions that a document stands for, with their text."""
    for batch in slices(batches, "text"):
        data, offsets = flat_text(batch.column("text"))
        some = batch.column("some")
        rows = some.flatten()
        counts = np.diff(np.asarray(some.offsets))
        base = np.repeat(offsets[:-1], counts)
        low, high = (base + np.asarray(rows.field(c)) for c in ("low", "high"))
        step = max(1, 8192 * 400 // max(1, int((high - low).max(initial=1))))
        for at in range(0, len(rows), step):
            part = rows.slice(at, step)
            a, b = low[at : at + step], high[at : at + step]
            ends = np.concatenate([[0], np.cumsum(b - a)])
            held = data[np.arange(ends[-1]) + np.repeat(a - ends[:-1], b - a)]
            text = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(held)])
            yield pa.record_batch([*[part.field(c) for c in ("key", "words", "copies", "deep", "block")], text], [c.split()[0] for c in TEXTS.split(", ")])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def longest_elsewhere(symbols: np.ndarray, most: int) -> np.ndarray:
    """For each place of symbols the length of the longest run from there that also begins at some other place; runs are shorter than `most`.

    The places are put in the order of what follows them, by doubling; a place's longest match is with a neighbour in that order.
    """
    n, size = len(symbols), 1
    ranks = [np.unique(symbols, return_inverse=True)[1]]
    while size < most:
        right = np.zeros(n, np.int64)
        right[: max(0, n - size)] = ranks[-1][size:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + right, return_inverse=True)[1])
        size *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + common, b + common
        inside = np.maximum(i, j) + (1 << k) <= n
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][i[inside]] == ranks[k][j[inside]]
        common[same] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[a] = common
    np.maximum.at(longest, b, common)
    return longest


def duplicate_spans(longest: np.ndarray, begin: int, end: int, window: int) -> list[tuple[int, int]]:
    """The duplicate spans of symbols[begin:end], factored greedily; longest is that of the whole reference."""
    out = []
    fits = begin + np.flatnonzero(longest[begin : max(begin, end - window + 1)] >= window)
    at = begin
    while (k := int(np.searchsorted(fits, at))) < len(fits):
        start = int(fits[k])
        stop = start + int(longest[start])
        out.append((start - begin, stop - begin))
        at = stop - window + 1  # the first window that crosses the factor's end
    return out


def _factor(window: int):
    def block(reference: pa.Table) -> pa.Table:
        """key, words, low, high: the duplicate spans, in words, of every region of the block."""
        keys, words, copies = (reference.column(c).to_numpy() for c in ("key", "words", "copies"))
        one = np.unique(np.stack([keys, words]), axis=1, return_index=True)[1]  # rows that are equal in all columns give their regions more than once
        keys, words, copies = keys[one], words[one], copies[one]
        text = reference.column("text").combine_chunks().take(pa.array(one))
        start, end, place = word_bounds(*(held := _bytes(text)))
        ids = np.unique(span_hashes(held[0], start, end), return_inverse=True)[1]
        size = np.diff(place)
        # a sign of its own ends each region, so that no run crosses it
        symbols = np.insert(ids, place[1:], len(ids) + np.arange(len(one)))
        longest = longest_elsewhere(symbols, int(size.max(initial=0)) + 1)
        begin = place[:-1] + np.arange(len(one))
        out: list[tuple[int, int, int]] = []
        for r in range(len(one)):
            spans = [(0, int(size[r]))] if copies[r] > 1 else duplicate_spans(longest, begin[r], begin[r] + size[r], window)
            out += [(r, a, b) for a, b in spans]
        r, low, high = np.array(out, np.int64).reshape(-1, 3).T
        return pa.table([pa.array(keys[r]), pa.array(words[r]), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["key", "words", "low", "high"])

    return block


SPANS = "key long, words long, low int, high int"


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                start, end, place = word_bounds(*(held := _bytes(batch.column("text"))))
                n = np.maximum(np.diff(place) - window + 1, 0)
                ends = np.cumsum(n)
                low = np.arange(ends[-1]) - np.repeat(ends - n, n)
                first = low + np.repeat(place[:-1], n)
                hashes = run_hashes(span_hashes(held[0], start, end), first, first + window).view(np.int64)
                own = [batch.column(c).take(pa.array(np.repeat(np.arange(len(n)), n))) for c in ("key", "words", "copies")]
                yield pa.record_batch([*own, pa.array(low, pa.int32()), pa.array(hashes)], ["key", "words", "copies", "low", "window"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out, spans = [], batch.column("spans").to_pylist()
        for text, some in zip(batch.column("text").to_pylist(), spans, strict=True):
            words = text.encode().split()  # at the same bytes as word_bounds
            gone = np.zeros(len(words), bool)
            for a, b in some or ():
                gone[a:b] = True
            left = [words[i] for i in np.flatnonzero(~gone)] if some else words
            out.append((len(words), len(words) - len(left), b" ".join(left).decode()))
        n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _merged(spans: Column) -> Column:
    """The same places in spans (low, high) in ascending order of which no two meet."""
    kind = "array<struct<low:int,high:int>>"

    def take(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["low"].alias("low"), F.greatest(last["high"], s["high"]).alias("high"))
        return F.when(last["high"] >= s["low"], F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), joined)).otherwise(F.array_append(done, s))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), take)


def _spans(rows: DataFrame, window: int) -> DataFrame:
    """(k1, k2, spans): for every row that has words in repeated windows a few rows with spans of these, array of (low, high): the words from low on, before high."""
    found = stored(rows.mapInArrow(_regions(window), REGIONS), "regions")
    keys = found.groupBy("key").agg(F.count("*").alias("all"), F.sum("weight").alias("weight"), (F.min("words") == F.max("words")).alias("alike"))
    keys = stored(keys.filter("weight > 1").select("key", F.expr("all > 1 and alike").alias("whole")), "keys")
    places = stored(found.join(keys, "key"), "places")
    whole = places.filter("whole").select(*_KEYS, F.array(F.struct(F.col("first").alias("low"), (F.col("first") + F.col("n") + window - 1).cast("int").alias("high"))).alias("spans"))

    mixed = places.filter("not whole")
    kinds = stored(mixed.groupBy("key", "words").agg(F.count("*").alias("copies"), F.min(F.struct(*_KEYS, "low", "high", "n")).alias("at")), "kinds")
    total = kinds.agg(F.sum(F.col("at.n") + window)).first()[0] or 0
    deep = stored(kinds.groupBy("key").agg(F.count("*").alias("n")).select("key", (F.col("n") > DEEP).alias("deep")), "deep")
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_WORDS))
    chosen = kinds.join(deep, "key").select("at.k1", "at.k2", F.struct("key", "words", "copies", "deep", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "at.low", "at.high").alias("one"))
    chosen = chosen.groupBy(*_KEYS).agg(F.collect_list("one").alias("some"))  # as many as the document is long
    texts = stored(rows.select(*_KEYS, "text").join(chosen, _KEYS).mapInArrow(_texts, TEXTS), "texts")

    factored = texts.filter("not deep").groupBy("block").applyInArrow(_factor(window), SPANS)
    # few documents may stand for all regions of such keys, so these are dealt out anew before they are cut
    windows = stored(texts.filter("deep").repartition("key", "words").mapInArrow(_windows(window), "key long, words long, copies long, low int, window long"), "windows")
    place = F.xxhash64("words", "low")
    twice = windows.groupBy("key", "window").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("copies").alias("copies"))
    twice = stored(twice.filter("a <> b or copies > 1").select("key", "window"), "twice")
    split = windows.join(twice, ["key", "window"]).select("key", "words", "low", (F.col("low") + window).alias("high"))
    spans = factored.union(split.select("key", "words", "low", F.col("high").cast("int").alias("high"))).groupBy("key", "words").agg(F.collect_set(F.struct("low", "high")).alias("spans"))  # as many as the region has windows
    spans = stored(spans.select("key", "words", _merged(F.col("spans")).alias("spans")), "spans")
    there = F.transform("spans", lambda s: F.struct((F.col("first") + s["low"]).alias("low"), (F.col("first") + s["high"]).alias("high")))
    return whole.union(mixed.join(spans, ["key", "words"]).select(*_KEYS, there.alias("spans")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, and kept, the words that are left, joined by one space.

    Words are runs of other bytes than space and tab to carriage return, unchanged. A word goes if it lies in a window of `window`
    words whose sequence begins at another place too, of the same or another row; windows are judged on the input. Rows that are equal in
    id and text are rows each, so all their windows stand twice. Null texts, empty texts and texts shorter than a window lose nothing. Ids play no part but in the
    result, and may be null or repeated. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"))
    spans = _spans(rows, window).groupBy(*_KEYS).agg(F.flatten(F.collect_set("spans")).alias("spans"))  # as many as the document has regions
    spans = spans.select(*_KEYS, F.transform("spans", lambda s: F.array(s["low"], s["high"])).alias("spans"))
    return rows.join(stored(spans, "documents"), _KEYS, "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")

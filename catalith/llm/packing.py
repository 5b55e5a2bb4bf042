"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted. Pieces are taken by falling length; each goes into the open bin that it leaves
with the least room. If none has room, the bin size opens that costs least for each token that it can be filled with:
its cost over the smaller of its size and all tokens still to be placed. So one pass decides on all sizes together: large bins
open while there is enough to fill them, small ones at the end. At last each bin shrinks to the least permitted size
that holds its contents.

Pieces are dealt by hash into groups of about GROUP, and each group is packed alone: memory and time don't grow with the
corpus, and at most the last bins of a group are less full than those of one large packing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import stored

SIZES = (512, 1024, 2048, 4096, 8192)
GROUP = 2048
#: Cost of a bin of n tokens: the tokens, what attention adds with the square of the length, and a constant for the sequence.
ATTENTION, SEQUENCE = 32_768, 64


def bin_cost(size: int) -> float:
    return size * (1 + size / ATTENTION) + SEQUENCE


def best_fit(lengths: list[int], sizes: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the bins' final sizes. lengths are sorted downwards and at most the greatest size."""
    sizes = tuple(sorted(sizes))
    costs = [bin_cost(s) for s in sizes]
    room: list[tuple[int, int]] = []  # (room left, bin) of open bins, sorted
    filled: list[int] = []
    bins, offsets = [], []
    left = sum(lengths)
    for n in lengths:
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            size = min((c / min(s, left), s) for s, c in zip(sizes, costs, strict=True) if s >= n)[1] if left else sizes[0]
            free, b = size, len(filled)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        left -= n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [next(s for s in sizes if s >= f) for f in filled]


def _packer(sizes: tuple[int, ...], more: list[str]):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort([table.column("piece").to_numpy(), table.column("doc_id").to_numpy(), -lengths])
        table = table.take(pa.array(order))
        bins, offsets, final = best_fit(lengths[order].tolist(), sizes)
        group = table.column("group")[0].as_py()
        ids = pa.array([(group << 32) + b for b in bins], pa.int64())
        names = ["doc_id", "piece", "start", "length", "bin_id", "bin_size", "bin_offset", *more]
        return pa.table([*(table.column(c) for c in names[:4]), ids, pa.array([final[b] for b in bins], pa.int32()), pa.array(offsets, pa.int32()), *(table.column(c) for c in more)], names)

    return pack


def pieces(docs: DataFrame, largest: int, by: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, and `by` if named: each text's words and an end mark, cut where they exceed the largest size."""
    more = [by] if by else []
    n = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), *more).filter("doc_id is not null")
    rows = rows.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(largest))).alias("piece", "start"), *more)
    return rows.select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(largest)).alias("length"), *more)


def pack(items: DataFrame, sizes: tuple[int, ...] = SIZES, by: str | None = None) -> DataFrame:
    """Packs items (doc_id, piece, start, length > 0): adds bin_id, bin_size, bin_offset.

    Lengths may not exceed the greatest size. Ties go by doc_id and piece, so the result doesn't depend on how rows are
    partitioned. Repeated rows are packed each time. No bin holds pieces of two values of the string column `by`, if named (null is one value); it
    should have few, such as languages, as each opens bins of its own and a list of them goes through the driver.
    """
    items, more = stored(items, "pieces"), [by] if by else []
    counts = items.groupBy(*more).agg(F.count("*").alias("n")).collect()
    counts.sort(key=lambda c: [(c[b] is not None, c[b] or "") for b in more])
    groups = [max(1, -(-c["n"] // GROUP)) for c in counts]
    piece = F.xxhash64("doc_id", "piece")
    if by:
        value, first, among = "_by", "_first", "_among"
        numbered = [(c[by], sum(groups[:k]), groups[k]) for k, c in enumerate(counts)]
        table = items.sparkSession.createDataFrame(numbered, f"{value} string, {first} long, {among} long")
        dealt = items.join(F.broadcast(table), F.col(by).eqNullSafe(F.col(value))).withColumn("group", (F.col(first) + F.pmod(piece, among)).cast("int"))
        dealt = dealt.drop(value, first, among)
    else:
        dealt = items.withColumn("group", F.pmod(piece, F.lit(groups[0])).cast("int"))
    schema = "doc_id long, piece int, start int, length int, bin_id long, bin_size int, bin_offset int" + "".join(f", `{c}` string" for c in more)
    return dealt.groupBy("group").applyInArrow(_packer(tuple(sizes), more), schema)


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, by: str | None = None) -> DataFrame:
    """Packs every document's word sequence with its end mark; one row per piece.

    A text counts its words (runs of other characters than space and tab to carriage return) and one end mark, so a null
    or empty text has length 1. A longer text than the greatest size is cut into pieces, none lost. Rows with a null
    doc_id can't be referred to and are left out. An empty table gives an empty result; other columns than `by`, see pack(), are ignored.
    """
    return pack(pieces(docs, max(sizes), by), sizes, by)

"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words wherever no piece can go on: between two characters that stand next to each other in no piece.
Distinct words are exploded into their substrings of at most the longest piece's length, an equi-join with the piece
table keeps those that are pieces, and the edges found are grouped by word into its lattice. A higher-order aggregate, Viterbi's
algorithm, folds each lattice into the word's best path: for every place it keeps the best cost of a path up to it and that path's last edge.

Costs are of two kinds:

* `score`, for unigram models: the sum of the pieces' scores, negated.
* `rank`, for models of byte-pair encoding, whose scores are the ranks at which pieces are merged. A path's cost is the ascending list
  of the merges inside its pieces, each as rank and place; the least list wins, a longer one before its own beginning.
  Byte-pair encoding always takes the merge of best rank, the leftmost of equal ones, so its own list is the least of all:
  where another path's list first differs, that path lacks a merge that was to be had at this point. What follows a
  place adds the same merges to every path up to it, which keeps their order, so the best path up to each place is all that
  Viterbi's algorithm must keep. The result is the library's own; the public model is of this kind.

The lists grow with the word, so words of over LONG characters are folded by taking the edges in order of rank instead, which is the same result
with one number for a place.

Words go to documents again by block: documents of neighbouring ids are a block, and each block gets the segmentation of
every word in it once, however often it occurs there. On the way words are dealt into parts by their CRC-32: a block asks each part for
its words, a part gives each block the ids of those. What a block and a part send one another, and the texts of a block, are compressed Arrow tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from catalith.llm.common import flat_text, runs, slices

SPACE = "▁"
#: Bytes of text of a block, about, and characters of a word up to which paths are held by their lists of merges.
BLOCK, LONG = 16 << 20, 64
#: Least number of parts that words are dealt into, words that a task holds before it asks for them, and ids that it decodes at a time.
PARTS, HELD, DECODED = 128, 2_000_000, 1 << 17
#: Part of a cost that names the place of a merge, and what ends a list of merges.
PLACE, LAST = 32, 2**63 - 1


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: `table` (piece, id, score, size) of those that text can hold, the ids of bytes and of the unknown."""

    texts: list[str]
    usable: list[tuple[str, int, float]]
    byte_ids: list[int]
    unknown: int
    prefix: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.usable)

    @cached_property
    def single(self) -> np.ndarray:
        """The id of every code point that is a piece, else -1."""
        found = {ord(p): i for p, i, _ in self.usable if len(p) == 1}
        out = np.full(max(found, default=0) + 1, -1, np.int32)
        out[list(found)] = list(found.values())
        return out

    def merges(self) -> dict[str, list[int]]:
        """For each piece of several characters that merging reaches: its merges as rank << PLACE | place, ascending."""
        rank = {p: r for r, (p, *_) in enumerate(sorted(self.usable, key=lambda x: (-x[2], x[1])))}
        found = {}
        for p in rank:
            edges = sorted((rank[p[a:b]], a, b) for a in range(len(p)) for b in range(a + 2, len(p) + 1) if p[a:b] in rank)
            nxt, done = list(range(1, len(p) + 1)), []
            for r, a, b in edges:
                m = nxt[a]
                if 0 < m < b and nxt[m] == b:
                    nxt[a], nxt[m] = b, 0
                    done.append(r << PLACE | a)
            if len(p) > 1 and nxt[0] == len(p):
                found[p] = done
        return found

    def table(self, spark: SparkSession, cost: str) -> DataFrame:
        """piece, id, cost of the pieces of several characters."""
        if cost == "score":
            return spark.createDataFrame([(p, i, -s) for p, i, s in self.usable if len(p) > 1], "piece string, id int, cost double")
        merges = self.merges()
        return spark.createDataFrame([(p, i, merges[p]) for p, i, _ in self.usable if p in merges], "piece string, id int, cost array<long>")


def load(path: str, prefix: bool = True) -> Pieces:
    """Reads the piece table of a SentencePiece model with identity normalisation; prefix: a text gets a blank before it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    texts = [model.id_to_piece(i) for i in ids]
    usable = [(texts[i], i, float(model.get_score(i))) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    by_byte = {texts[i]: i for i in ids if model.is_byte(i)}
    byte_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if by_byte else []
    return Pieces(texts, usable, byte_ids, model.unk_id(), prefix)


def normalised(text: Column, prefix: bool = True) -> Column:
    """Blanks become U+2581; a non-empty text gets one before it."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.translate(F.when(text == "", "").otherwise(F.concat(F.lit(" " if prefix else ""), text)), " ", SPACE)


class Cutter:
    """Cuts normalised texts into words."""

    def __init__(self, pieces: Pieces):
        pairs = {(ord(a), ord(b)) for p, *_ in pieces.usable for a, b in zip(p, p[1:], strict=False)}
        known = sorted({c for pair in pairs for c in pair})
        self.number = np.zeros(max(known, default=0) + 2, np.int32)
        self.number[known] = np.arange(1, len(known) + 1)
        self.joined = np.zeros((len(known) + 1, len(known) + 1), bool)
        for a, b in pairs:
            self.joined[self.number[a], self.number[b]] = True
        self.before = SPACE if pieces.prefix else ""

    def cut(self, texts: list[str | None]) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all texts one after the other, and for each text how many there are up to its end."""
        texts = [(self.before + t).replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.number[np.minimum(points, len(self.number) - 1)]
        cuts = np.ones(len(points) + 1, bool)
        cuts[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        cuts[ends] = True
        width = np.ones(len(points) + 1, np.int8)
        for least in (0x80, 0x800, 0x10000):
            width[1:] += points >= least
        width[0] = 0
        offsets = np.cumsum(width, dtype=np.int32)[cuts]
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        return words, np.cumsum(cuts, dtype=np.int64)[ends] - 1

    def words(self, text: str | None) -> list[str]:
        return self.cut([text])[0].to_pylist()


def _packed(**columns: pa.Array) -> bytes:
    """A table as compressed bytes."""
    batch, sink = pa.record_batch(list(columns.values()), list(columns)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(held).read_next_batch()


def _sent(words: pa.Array, ids: pa.Array | None = None, kind: type = np.int32) -> bytes:
    """Words, and their ids as numbers of a kind, as compressed bytes: lengths stand in place of ends, which are compressed less well."""
    one = lambda x: pa.ListArray.from_arrays([0, len(x)], pa.array(x))
    data, offsets = flat_text(words)
    more = {} if ids is None else {"n": one(ids.value_lengths().cast(pa.int32())), "ids": one(np.asarray(ids.flatten()).astype(kind))}
    return _packed(text=pa.array([data.tobytes()], pa.binary()), size=one(np.diff(offsets).astype(np.int32)), **more)


def _received(held: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words, the number of ids of each, and all ids."""
    row = _unpacked(held)
    size, *ids = (np.asarray(row.column(k).values) for k in row.schema.names[1:])
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), row.column("text")[0].as_buffer())
    return words, *(x.astype(np.int32) for x in ids or [np.empty(0), np.empty(0)])


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start:start + size], one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]


class Decoder:
    """Reads ids as text, about DECODED of them at a time, as gathering takes several numbers for each byte of their text."""

    def __init__(self, pieces: Pieces):
        by_byte = {i: b for b, i in enumerate(pieces.byte_ids)}
        raw = [bytes([by_byte[i]]) if i in by_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces.texts)] + [b""]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)
        self.prefix, self.most = pieces.prefix, DECODED

    def parts(self, batch: pa.RecordBatch, ids_col: str = "ids") -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
        """The rows of batch in parts, and the texts of their ids."""
        column = batch.column(ids_col)
        sizes, at = np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64)), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + self.most, side="right")))
            yield batch.slice(at, stop - at), self.texts(column.slice(at, stop - at))
            at = stop

    def texts(self, lists: pa.ListArray) -> pa.StringArray:
        ids = np.asarray(lists.flatten().cast(pa.int64()).fill_null(-1))
        said = b"".join(self._bytes(ids[k : k + self.most]) for k in range(0, len(ids), self.most))
        ends = np.append(0, np.cumsum(self.size[self._known(ids)]))[np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64)))].tolist()
        return pa.array([self._text(said[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)], pa.string())

    def _known(self, ids: np.ndarray) -> np.ndarray:
        """Ids, with the last place, which is empty, for numbers that are none."""
        return np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size) - 1)

    def _bytes(self, ids: np.ndarray) -> bytes:
        ids = self._known(ids)
        return _gathered(self.data, self.start[ids], self.size[ids]).tobytes()

    def _text(self, held: bytes) -> str:
        said = held.decode("utf-8", "replace")
        return said[1:] if self.prefix and said.startswith(" ") else said


def lattice(words_: DataFrame, pieces: Pieces, cost: str = "rank") -> DataFrame:
    """word and its edges, an array of (start, stop, id, cost), for each distinct word; edges of a single character are left out."""
    table = F.broadcast(pieces.table(words_.sparkSession, cost))  # as many rows as the model's vocabulary
    n = F.length("word")
    places = words_.select("word", F.explode(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array(F.lit(0)))).alias("start"))
    spans = places.select("word", "start", F.explode(F.when(n > 1, F.sequence(F.lit(2), F.least(F.lit(max(2, pieces.longest)), n - F.col("start")))).otherwise(F.array(F.lit(1)))).alias("size"))
    spans = spans.withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("size")))
    edge = F.struct("start", (F.col("start") + F.col("size")).alias("stop"), "id", "cost")
    found = spans.join(table, "piece", "left").filter("id is not null or start = 0 and size <= 2")  # a word without any piece keeps a row
    return found.groupBy("word").agg(F.collect_list(F.when(F.col("id").isNotNull(), edge)).alias("edges"))


def _viterbi(word: Column, edges: Column, cost: str, unknown: float) -> Column:
    """Array of (start, stop) of the path of least cost; under `score` a single character costs single(), see segmented()."""
    n = F.length(word)
    if cost == "rank":
        zero = F.array(F.lit(LAST))
        alone = lambda at, i: at  # noqa: E731  no merge is made
        add = lambda at, e: F.array_sort(F.concat(at, F.transform(e["cost"], lambda c: c + e["start"])))
    else:
        zero = F.lit(0.0)
        alone = lambda at, i: at + unknown
        add = lambda at, e: at + e["cost"]
    first = F.array(F.struct(zero.alias("cost"), F.lit(0).alias("back")))

    def step(state: Column, i: Column) -> Column:
        held = lambda at: F.get(state, at)["cost"]
        ends = F.transform(F.filter(edges, lambda e: e["stop"] == i), lambda e: F.struct(add(held(e["start"]), e).alias("cost"), e["start"].alias("back")))
        return F.concat(state, F.array(F.array_min(F.concat(ends, F.array(F.struct(alone(held(i - 1), i).alias("cost"), (i - 1).alias("back")))))))

    back = F.transform(F.aggregate(F.sequence(F.lit(1), n), first, step), lambda x: x["back"])

    def walk(back: Column) -> Column:
        start = F.struct(n.alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("path"))
        to = lambda s: F.get(back, s["at"])
        return F.aggregate(F.sequence(F.lit(1), n), start, lambda s, _: F.when(s["at"] > 0, F.struct(to(s).alias("at"), F.concat(F.array(F.struct(to(s).alias("start"), s["at"].alias("stop"))), s["path"]).alias("path"))).otherwise(s))["path"]

    return F.get(F.transform(F.array(back), walk), F.lit(0))


def _merged(word: Column, edges: Column) -> Column:
    """Array of (start, stop) by taking the edges in order of rank: next[i] is where the token that starts at i stops, 0 if none starts there."""
    ranked = F.array_sort(F.transform(edges, lambda e: F.struct(F.shiftright(F.element_at(e["cost"], -1), PLACE).alias("rank"), e["start"].alias("start"), e["stop"].alias("stop"))))

    def step(state: Column, e: Column) -> Column:
        middle = F.get(state, e["start"])
        fits = (middle > 0) & (middle < e["stop"]) & (F.get(state, middle) == e["stop"])
        return F.when(fits, F.transform(state, lambda x, i: F.when(i == e["start"], e["stop"]).when(i == middle, 0).otherwise(x))).otherwise(state)

    done = F.aggregate(ranked, F.sequence(F.lit(1), F.length(word)), step)
    return F.filter(F.transform(done, lambda x, i: F.struct(i.alias("start"), x.alias("stop"))), lambda t: t["stop"] > 0)


def _tokens(words_: DataFrame, pieces: Pieces, cost: str, long: int = LONG) -> DataFrame:
    """word, tokens for each distinct word: ids of pieces; a single character stands as -1 less its code point."""
    word, edges = F.col("word"), F.col("edges")
    unknown = 10.0 - min(s for _, _, s in pieces.usable)
    path = _viterbi(word, edges, cost, unknown)
    path = F.when(F.length(word) <= long, path).otherwise(_merged(word, edges)) if cost == "rank" else path
    found = lattice(words_, pieces, cost).select("word", "edges", path.alias("path"))
    known = lambda t: F.get(F.filter(edges, lambda e: (e["start"] == t["start"]) & (e["stop"] == t["stop"])), F.lit(0))["id"]
    alone = lambda t: -1 - F.ascii(F.substring(word, t["start"] + 1, F.lit(1)))
    return found.select("word", F.transform("path", lambda t: F.when(t["stop"] == t["start"] + 1, alone(t)).otherwise(known(t))).alias("tokens"))


def _ids(pieces: Pieces, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ends of the lists of tokens: characters become their piece, their bytes' pieces, or the unknown one."""
    points = np.maximum(-1 - tokens, 0)
    ids = np.where(tokens < 0, pieces.single[np.minimum(points, len(pieces.single) - 1)], tokens)
    ids[(tokens < 0) & (points >= len(pieces.single))] = -1
    lost = np.flatnonzero(ids < 0)
    if not len(lost):
        return ids, ends
    as_bytes = [[pieces.byte_ids[b] for b in chr(points[i]).encode("utf-8", "replace")] if pieces.byte_ids else [pieces.unknown] for i in lost]
    size = np.ones(len(ids), np.int64)
    size[lost] = [len(x) for x in as_bytes]
    out, at = np.repeat(ids, size), np.cumsum(size) - size
    for i, x in zip(lost, as_bytes, strict=True):
        out[at[i] : at[i] + len(x)] = x
    return out, np.append(at, len(out))[ends]


def segmented(words_: DataFrame, pieces: Pieces, fold: str = "rank") -> DataFrame:
    """word and its ids, for each distinct word, by the path of least cost (fold: `rank`, or `score` alias `viterbi`). Null and empty words have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            offsets = np.asarray(column.offsets, np.int64)
            ids, ends = _ids(pieces, np.asarray(column.values, np.int32)[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.record_batch([batch.column("word"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["word", "ids"])

    asked = words_.select("word").filter("word <> ''").distinct()
    return _tokens(asked, pieces, "score" if fold in ("score", "viterbi") else "rank").mapInArrow(run, "word string, ids array<int>")


def encode(docs: DataFrame, pieces: Pieces, fold: str = "rank", id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of every row of docs; decoded: also the text `decoded` as by decode(), read in the task that has the ids.

    A null or empty text has no ids. Ids may have any values. Repeated rows give repeated results; an empty table gives
    an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, (size["bytes"] or 0) // BLOCK)
    rows = rows.withColumn("block", runs(rows, max(1, size["n"] // blocks))).drop("tie")
    parts = max(PARTS, blocks)
    cutter, kind, decoder = Cutter(pieces), np.min_scalar_type(len(pieces.texts)), Decoder(pieces) if decoded else None
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.string()] * decoded]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Array]] = {}

        def asked() -> Iterator[pa.RecordBatch]:
            for block, some in held.items():
                words = pa.chunked_array(some).unique().sort()
                part = np.fromiter((crc32(w) % parts for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
                order = np.argsort(part, kind="stable")
                numbers, starts = np.unique(part[order], return_index=True)
                sent = [_sent(words.take(pa.array(some))) for some in np.split(order, starts[1:])] if len(words) else []
                yield pa.record_batch([pa.array([block] * len(sent), pa.int64()), pa.array(numbers, pa.int64()), pa.array(sent, pa.binary())], ["block", "part", "asked"])
            held.clear()

        for batch in slices(batches, "text"):
            for block, some in by_block(batch):
                held.setdefault(block, []).append(cutter.cut(some.column("text").to_pylist())[0].unique())
            if sum(len(x) for some in held.values() for x in some) > HELD:
                yield from asked()
        yield from asked()

    def by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        block = batch.column("block").to_numpy()
        for b in np.unique(block).tolist():
            yield b, batch.filter(pa.array(block == b))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for block, some in by_block(batch):
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([_packed(doc_id=some.column("doc_id"), text=some.column("text"))], pa.binary())], ["block", "docs"])

    def listed(asked: pa.Table) -> pa.Table:
        return pa.table([pa.chunked_array([_received(x)[0] for x in asked.column("asked").to_pylist()], pa.string()).unique()], ["word"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [_received(x)[0] for x in left.column("asked").to_pylist()]
        ids = right.column("ids").combine_chunks()
        found = ids.take(pc.index_in(pa.concat_arrays(asked), value_set=right.column("word").combine_chunks())) if asked else ids
        ends = np.cumsum([len(x) for x in asked], dtype=np.int64)
        sent = [_sent(x, found.slice(end - len(x), len(x)), kind) for x, end in zip(asked, ends.tolist(), strict=True)]
        return pa.table([left.column("block"), pa.array(sent, pa.binary())], ["block", "answers"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [_received(x) for x in right.column("answers").to_pylist()]
        words = pa.concat_arrays([pa.array([], pa.string()), *(w for w, _, _ in known)])
        sizes, values = (np.concatenate([np.empty(0, np.int32), *(x[k] for x in known)]) for k in (1, 2))
        del known
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        out = []
        for docs in map(_unpacked, left.column("docs").to_pylist()):
            cut, ends = cutter.cut(docs.column("text").to_pylist())
            coded = cut.dictionary_encode()
            at = np.asarray(pc.index_in(coded.dictionary, value_set=words), np.int64)[np.asarray(coded.indices)]
            stops = np.append(0, np.append(0, np.cumsum(sizes[at], dtype=np.int64))[ends]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(stops), pa.array(_gathered(values, starts[at], sizes[at]), pa.int32()))
            rows = pa.record_batch([docs.column("doc_id"), pa.array(np.diff(stops), pa.int32()), ids], names[:3])
            del cut, coded, at
            texts = [pa.chunked_array([t for _, t in decoder.parts(rows)], pa.string()).combine_chunks()] if decoder else []
            out.append(pa.table([*rows.columns, *texts], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in types], names)

    asked = rows.select("block", "text").mapInArrow(ask, "block long, part long, asked binary").repartition("part")
    words = asked.groupBy("part").applyInArrow(listed, "word string").repartition(parts, "word")  # many edges a word: no fewer tasks than parts
    known = segmented(words, pieces, fold).withColumn("part", F.crc32("word") % parts)
    answers = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, "block long, answers binary")
    texts = rows.select("block", "doc_id", "text").mapInArrow(send, "block long, docs binary")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id long, n_tokens int, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """encoded with the column `decoded`: the pieces' text, bytes read as UTF-8, without the blank that was put before it.

    Null ids give null; numbers that are no id are left out.
    """
    others = encoded.drop("decoded") if ids_col != "decoded" else encoded
    decoder = Decoder(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in decoder.parts(batch, ids_col):
                yield pa.record_batch([*rows.columns, texts], [*rows.schema.names, "decoded"])

    return others.mapInArrow(run, StructType([*others.schema.fields, StructField("decoded", StringType())]))


def default_model() -> str:
    """Path of the public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")

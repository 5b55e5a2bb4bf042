"""Token ids as a binary table coded by a range asymmetric numeral system (rANS) with static shared frequencies.

Texts are dealt by range of doc_id, tokenised, and coded shard by shard. A shard is up to SHARD tokens of neighbouring
documents and has one frequency table, which all its blocks share. A block holds whole documents, about BLOCK tokens,
and can be decoded alone. Inside a block LANES interleaved states take the tokens in turn; every CHECKPOINT tokens the
states and the place in the stream are noted, so that the parts between checkpoints can be decoded at the same time. A
checksum of the ids ends each block.

The output is a table of such binary records in Spark's own files, which gives atomic commits on any file system:
`shard` and `block` order the records, `head` holds the shard's frequency table, `body` the block.

head: magic "RANT", u8 version, u8 bits of the total, u32 number of symbols; then for each symbol u32 id and u32 frequency.
body: magic "RANS", u8 version, u8 lanes, u32 checkpoint, u32 documents, u32 tokens, u32 words, u32 parts, u32 crc32 of the
ids as little-endian u32; then i64 doc_id and u32 tokens of each document, for each part u32 place in the words and LANES u64 states,
then the u32 words. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import flat_text, shared_dir, slices, span_hashes, stored

#: The id that ends a document.
END = 0
BITS, LANES, CHECKPOINT, BLOCK, SHARD = 20, 64, 16_384, 524_288, 4 << 20
#: Pieces of text that a task remembers.
MEMORY = 1_500_000
VERSION = 1
_U = np.uint64
_LOW = _U(1 << 31)
_HEAD, _BODY = struct.Struct("<4sBBI"), struct.Struct("<4sBBIIIIII")


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS, at least 1 for each symbol."""
    total = 1 << BITS
    freq = np.maximum(1, counts * total // counts.sum())
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    for i in order:
        if over == 0:
            break
        change = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= change
        over -= change
    return freq.astype(np.int64)


def encode_parts(symbols: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes positions in the frequency table: the u32 words, and each part's place among them and states."""
    start = np.cumsum(freq) - freq
    parts = max(1, -(-len(symbols) // CHECKPOINT))
    steps = CHECKPOINT // LANES
    padded = np.zeros(parts * CHECKPOINT, np.int64)
    padded[: len(symbols)] = symbols
    real = (np.arange(parts * CHECKPOINT) < len(symbols)).reshape(parts, steps, LANES)
    grid = padded.reshape(parts, steps, LANES)
    state = np.full((parts, LANES), _LOW, _U)
    given, spilled = np.zeros((parts, steps, LANES), np.uint32), np.zeros((parts, steps, LANES), bool)
    f_all, c_all = freq.astype(_U)[grid], start.astype(_U)[grid]
    for step in range(steps - 1, -1, -1):
        f, c, live = f_all[:, step], c_all[:, step], real[:, step]
        full = live & (state >= f << _U(63 - BITS))
        given[:, step], spilled[:, step] = state & _U(0xFFFFFFFF), full
        state = np.where(full, state >> _U(32), state)
        whole = state // f
        state = np.where(live, (whole << _U(BITS)) + (state - whole * f) + c, state)
    counts = spilled.sum(axis=(1, 2))
    return given[spilled], (np.cumsum(counts) - counts).astype(np.uint32), state


def decode_parts(words: np.ndarray, place: np.ndarray, states: np.ndarray, n: int, freq: np.ndarray) -> np.ndarray:
    """The positions that encode_parts() coded; all parts advance together."""
    start = (np.cumsum(freq) - freq).astype(_U)
    symbol = np.repeat(np.arange(len(freq)), freq)
    f_of = freq.astype(_U)
    parts, steps = len(place), CHECKPOINT // LANES
    out = np.zeros((parts, steps, LANES), np.int64)
    real = (np.arange(parts * CHECKPOINT) < n).reshape(parts, steps, LANES)
    state, at = states.copy(), place.astype(np.int64)
    words = np.append(words, np.uint32(0))
    for step in range(steps):
        live = real[:, step]
        if not live.any():
            break
        slot = state & _U((1 << BITS) - 1)
        got = symbol[slot.astype(np.int64)]
        out[:, step] = got
        state = np.where(live, f_of[got] * (state >> _U(BITS)) + slot - start[got], state)
        need = live & (state < _LOW)
        order = np.cumsum(need, axis=1)
        read = words[np.minimum(at[:, None] + order - 1, len(words) - 1)].astype(_U)
        state = np.where(need, (state << _U(32)) | read, state)
        at += order[:, -1]
    return out.reshape(-1)[:n]


def pack_head(ids: np.ndarray, freq: np.ndarray) -> bytes:
    return _HEAD.pack(b"RANT", VERSION, BITS, len(ids)) + np.column_stack([ids, freq]).astype("<u4").tobytes()


def unpack_head(head: bytes) -> tuple[np.ndarray, np.ndarray]:
    magic, version, bits, n = _HEAD.unpack_from(head)
    if (magic, version, bits) != (b"RANT", VERSION, BITS):
        raise ValueError("not a frequency table of this version")
    pairs = np.frombuffer(head, "<u4", 2 * n, _HEAD.size).reshape(n, 2)
    return pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def pack_block(doc_ids: list[int], docs: list[np.ndarray], symbols: np.ndarray, freq: np.ndarray) -> bytes:
    ids = np.concatenate(docs).astype("<u4")
    words, place, states = encode_parts(symbols, freq)
    head = _BODY.pack(b"RANS", VERSION, LANES, CHECKPOINT, len(docs), len(ids), len(words), len(place), zlib.crc32(ids.tobytes()))
    parts = b"".join(np.uint32(p).astype("<u4").tobytes() + s.astype("<u8").tobytes() for p, s in zip(place, states, strict=True))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array([len(d) for d in docs], "<u4").tobytes(), parts, words.astype("<u4").tobytes()])


def unpack_block(head: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, tokens of each, and all token ids. A checksum that doesn't hold raises ValueError."""
    names, freq = unpack_head(head)
    magic, version, lanes, checkpoint, n_docs, n, n_words, n_parts, crc = _BODY.unpack_from(body)
    if (magic, version, lanes, checkpoint) != (b"RANS", VERSION, LANES, CHECKPOINT):
        raise ValueError("not a block of this version")
    at = _BODY.size
    doc_ids = np.frombuffer(body, "<i8", n_docs, at)
    lengths = np.frombuffer(body, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    size = 4 + 8 * LANES
    parts = [body[at + p * size : at + (p + 1) * size] for p in range(n_parts)]
    place = np.array([struct.unpack_from("<I", p)[0] for p in parts])
    states = np.array([np.frombuffer(p, "<u8", LANES, 4) for p in parts]).astype(_U)
    words = np.frombuffer(body, "<u4", n_words, at + n_parts * size)
    ids = names[decode_parts(words, place, states, n, freq)].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's checksum doesn't hold")
    return doc_ids, lengths, ids


# fixed values: white space as UTF-8. Bytes that may end or begin a white-space character aren't sure to be visible.
_SURE_END, _SURE_START = np.ones(256, bool), np.ones(256, bool)
_SURE_END[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_SURE_START[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False


class Encoder:
    """Token ids of texts by a byte-level BPE of the tokenizers library.

    Its pattern cuts before every blank that follows or precedes a visible character, so what stands between such blanks
    can be encoded alone: once, and remembered by a 64-bit hash. New pieces are encoded many at a time, one after the
    other in one string, and told apart by the bytes of their tokens.

    Where the text holds an added token as `<|endoftext|>`, it is plain text by default; with `added` it becomes that
    token, as by the library's own default. Such texts are encoded whole, one by one, by the unchanged tokenizer.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = Tokenizer.from_file(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()] if added else []
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(vocab.values()) < 65_536 else np.uint32
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = len(token)  # in a byte-level vocabulary a character stands for a byte
        self.reset()

    def reset(self) -> None:
        """Piece 0 is the end of a document."""
        self.keys, self.slots = np.empty(0, _U), np.empty(0, np.int64)
        self.ids, self.ends = np.full(1, END, self.kind), np.array([0, 1])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encodes new pieces data[start:end] and gives their numbers."""
        even = (end - start >= 2) & (data[start] == 32) & _SURE_START[data[np.minimum(start + 1, len(data) - 1)]]
        numbers = np.zeros(len(start), np.int64)
        flat, ends, count = [self.ids], [self.ends], len(self.ends) - 1
        chosen, odd = np.flatnonzero(even), [np.flatnonzero(~even)]
        for k in range(0, len(chosen), 2000):
            some = chosen[k : k + 2000]
            size = end[some] - start[some]
            stop = np.cumsum(size)
            joined = data[np.arange(stop[-1]) + np.repeat(start[some] - (stop - size), size)]
            ids = self._ids([joined.tobytes().decode()])[0]
            width = np.cumsum(self.bytes[ids])
            at = np.searchsorted(width, stop)
            if at[-1] != len(ids) - 1 or (width[at] != stop).any():
                odd.append(some)
                continue
            numbers[some] = np.arange(count, count + len(some))
            count += len(some)
            flat.append(ids)
            ends.append(ends[-1][-1] + at + 1)
        rest = np.concatenate(odd)
        for k in range(0, len(rest), 2000):
            some = rest[k : k + 2000]
            got = self._ids([data[a:b].tobytes().decode() for a, b in zip(start[some], end[some], strict=True)])
            numbers[some] = np.arange(count, count + len(some))
            count += len(some)
            flat += got
            ends.append(ends[-1][-1] + np.cumsum([len(g) for g in got]))
        self.ids, self.ends = np.concatenate(flat), np.concatenate(ends)
        return numbers

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text with the end id."""
        if len(self.keys) > MEMORY:
            self.reset()
        if self.added:
            texts = texts.cast(pa.string()).fill_null("")
            whole = np.any([pa.compute.match_substring(texts, t).to_numpy(zero_copy_only=False) for t in self.added], axis=0)
            if whole.any():
                out = self._encode(pa.compute.if_else(pa.array(whole), "", texts))
                at = np.flatnonzero(whole)
                for i, e in zip(at, self.plain.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
                    out[i] = np.array([*e.ids, END], self.kind)
                return out
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = flat_text(texts)
        first = offsets[:-1][np.diff(offsets) > 0]
        blank = np.flatnonzero(data == 32)
        before = data[np.maximum(blank - 1, 0)]
        after = data[np.minimum(blank + 1, max(0, len(data) - 1))]
        closing = np.zeros(len(data) + 1, bool)
        closing[offsets[1:]] = True
        after[closing[blank + 1]] = 32
        begins = np.zeros(len(data), bool)
        begins[first] = begins[blank[_SURE_END[before] | _SURE_START[after]]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))[: len(start)]
        keys, where, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        numbers = np.empty(len(keys), np.int64)
        numbers[~new] = self.slots[at[~new]]
        if new.any():
            numbers[new] = self._learn(data, start[where[new]], end[where[new]])
            self.keys, self.slots = np.insert(self.keys, at[new], keys[new]), np.insert(self.slots, at[new], numbers[new])
        last = np.searchsorted(start, offsets[1:])
        pieces = np.insert(numbers[which], last, 0)
        size = self.ends[pieces + 1] - self.ends[pieces]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.ends[pieces] - total[:-1], size)]
        return np.split(ids, total[last + np.arange(1, len(last) + 1)][:-1]) if len(last) else []


@cache
def encoder(path: str, added: bool = False) -> Encoder:
    """The worker's own encoder, which remembers pieces from one task to the next."""
    return Encoder(path, added)


RECORD = "shard long, block long, n_docs long, n_tokens long, head binary, body binary"


def write_blocks(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """Tokenises docs (doc_id, text; null: empty) in ascending doc_id (equal ids by text) and gives the table of records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(tokenizer, added).encode, TaskContext.get().partitionId(), 0
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            count = sum(np.bincount(np.concatenate(held[i : i + 512]), minlength=1 << 16) for i in range(0, len(held), 512))
            names = np.flatnonzero(count)
            freq = _normalised(count[names].astype(np.int64))
            position = np.zeros(len(count), np.int64)
            position[names] = np.arange(len(names))
            head, first, block = pack_head(names, freq), 0, 0
            while first < len(held):
                last, n = first, 0
                while last < len(held) and (last == first or n + len(held[last]) <= BLOCK):
                    n += len(held[last])
                    last += 1
                body = pack_block(held_ids[first:last], held[first:last], position[np.concatenate(held[first:last])], freq)
                yield pa.record_batch([pa.array([(part << 32) + shard]), pa.array([block]), pa.array([last - first]), pa.array([n]), pa.array([head if block == 0 else None], pa.binary()), pa.array([body], pa.binary())], ["shard", "block", "n_docs", "n_tokens", "head", "body"])
                first, block = last, block + 1

        for batch in slices(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                held_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size >= SHARD:
                    yield from flush()
                    held_ids, held, size, shard = [], [], 0, shard + 1
        if held:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, RECORD)


def read_blocks(records: DataFrame) -> DataFrame:
    """Decodes a table of records: one row per document with doc_id, start, n_tokens and the binary `ids` (u32, little-endian).

    start counts the ids of all documents before. Shards follow one another by number; only their sizes are put in order.
    """
    sizes = records.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block")
    starts = records.select("shard", "block", "n_tokens").withColumn("block_start", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    starts = starts.join(before, "shard").select("shard", "block", (F.col("block_start") + F.col("shard_start")).alias("start"))
    heads = records.filter("block = 0").select("shard", "head")
    rows = records.drop("head").join(starts, ["shard", "block"]).join(heads, "shard").select("head", "body", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                head, body, start = (batch.column(c)[i].as_py() for c in range(3))
                doc_ids, lengths, ids = unpack_block(head, body)
                ends = np.cumsum(lengths.astype(np.int64))
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.record_batch([pa.array(doc_ids.astype(np.int64)), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """Writes the records to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty and has the end id alone. Rows with a null doc_id have no place in the order and are
    left out. Repeated rows are written each time. An empty table gives an empty result.
    """
    shared_dir(docs.sparkSession)
    back = read_blocks(stored(write_blocks(docs, tokenizer, added), "tokens"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def default_tokenizer() -> str:
    """Path of the public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

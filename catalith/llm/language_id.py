"""Language identification by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: a slot is a row of 64-bit words in which language l has bit l % 64 of word
l // 64; there are as many words as the languages need. An n-gram is put into HASHES slots for each language that has it; the AND of an n-gram's slots is the set of all languages that may hold
it, so one probe answers for every language. A text's count for a language is the popcount of that bit over its n-grams,
less the false positives to be expected from how full that language's bit plane is. The greatest corrected count
decides; the score is its share of all corrected counts.

N-grams are runs of N bytes of the lower-cased UTF-8 text with at most one separator; separators are the ASCII bytes
that are no letters. A text without any, as it is too short, is told by its runs of 1 to N - 1 bytes, a separator put
at both ends. A language holds the n-grams that it has at least LEAST times and at a rate of at least SHARE of the
n-gram's highest rate in any language, at most FILTER of them by count; runs of N bytes and shorter ones count apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import flat_text, mix, slices

N, HASHES, SLOT_BITS = 5, 3, 21
LEAST, SHARE, FILTER = 3, 0.2, 60_000
#: Documents of a language that the filters are learned from, about; a bounded sample of labelled rows.
TRAIN = 3000
#: Languages in one word of a slot.
WORD = 64
UNKNOWN = "und"

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_MASK = _U((1 << (8 * N)) - 1)


@dataclass(frozen=True)
class Filters:
    """languages[l] belongs to bit l % WORD of slots[l // WORD]; false_positive[l] is the chance that an absent n-gram seems present."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    def classify(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        texts = texts.cast(pa.string()).fill_null("")
        letters = np.array(pc.match_substring_regex(texts, r"\p{L}").to_pylist(), bool) & bool(self.languages)
        docs, grams = _grams(texts)
        short = np.flatnonzero(letters & (np.bincount(docs, minlength=len(texts)) == 0))
        if len(short):
            padded = pc.binary_join_element_wise("", texts.take(pa.array(short)), "", " ")
            found = [(docs, grams)] + [(short[d], g) for d, g in (_grams(padded, size) for size in range(1, N))]
            docs, grams = (np.concatenate(x) for x in zip(*found, strict=True))
        total = np.bincount(docs, minlength=len(texts))
        corrected = np.zeros((len(texts), max(1, len(self.languages))))
        for word, slots in enumerate(self.slots):
            mask = np.full(len(grams), _U(2**64 - 1))
            for place in _places(grams):
                mask &= slots[place]
            for bit, wrong in enumerate(self.false_positive[word * WORD : (word + 1) * WORD]):
                hits = np.bincount(docs[(mask >> _U(bit)) & _U(1) == 1], minlength=len(texts))
                corrected[:, word * WORD + bit] = np.maximum(0, (hits - total * wrong) / (1 - wrong))
        best, known = corrected.argmax(axis=1), corrected.sum(axis=1)
        score = np.divide(corrected.max(axis=1), known, out=np.zeros(len(known)), where=known > 0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def _grams(texts: pa.Array, size: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Text number and value of every n-gram of `size` bytes; a shorter one's value begins with the number of bytes that it has less than N."""
    data, offsets = flat_text(pc.utf8_lower(texts.cast(pa.string()).fill_null("")))
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, _U)
    folded = _FOLD[data]
    value, blanks = np.full(n, _U(N - size)), np.zeros(n, np.int8)
    space = (folded == 32).view(np.int8)
    for j in range(size):
        value = (value << _U(8)) | folded[j : n + j]
        blanks += space[j : n + j]
    whole = blanks <= (size > 1)
    for edge in offsets[1:-1]:
        whole[max(0, edge - size + 1) : edge] = False
    at = np.flatnonzero(whole)
    return np.searchsorted(offsets, at, side="right") - 1, value[at]


def _places(grams: np.ndarray) -> Iterator[np.ndarray]:
    h = mix(grams)
    for i in range(HASHES):
        yield ((h >> _U(SLOT_BITS * i)) & _U((1 << SLOT_BITS) - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        for size in range(1, N + 1):
            docs, grams = _grams(batch.column("text"), size)
            for k, name in enumerate(names):
                values, counts = np.unique(grams[code[docs] == k], return_counts=True)
                if len(values):
                    yield pa.record_batch([pa.array([name] * len(values)), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def fit(rows: DataFrame, train: int = TRAIN, id_col: str = "doc_id") -> Filters:
    """Learns the filters from rows (text, lang); about `train` rows of each language count, all of a language that has no more, chosen by hash of id and text.

    Rows with null text or lang are left out; every language that is left counts. Without any row no language is known. Rows that are equal in both, as where there is no id, are chosen together; of
    each language the one of least hash is always among the chosen.
    """
    rows = rows.filter("text is not null and lang is not null")
    rows = rows.select("text", "lang", F.xxhash64("text", *[id_col][: id_col in rows.columns]).alias("at"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min(F.pmod("at", F.lit(1 << 20))).alias("least")).orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), _U), np.zeros(0))
    part = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(min(1.0, train / r["count"]), (r["least"] + 1) / (1 << 20)))]), F.col("lang"))
    sample = rows.filter(F.pmod("at", F.lit(1 << 20)) < part * (1 << 20)).drop("at")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # bytes of n-grams are 32 and above, the numbers that shorter runs begin with below
    counts = counts.withColumn("short", F.col("gram") < F.lit(32 << 8 * (N - 1)))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang", "short"))
    kept = counts.withColumn("rate", rate).withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter((F.col("n") >= LEAST) & (F.col("rate") >= SHARE * F.col("top")))
    order = Window.partitionBy("lang", "short").orderBy(F.desc("n"), "gram")
    found = kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= FILTER).select("lang", "gram").toPandas()
    languages = [r["lang"] for r in sizes]
    slots = np.zeros((-(-len(languages) // WORD), 1 << SLOT_BITS), _U)
    full = []
    held = {name: grams.to_numpy(np.int64).view(_U) for name, grams in found.groupby("lang")["gram"]}
    for bit, name in enumerate(languages):
        word, one = slots[bit // WORD], _U(1 << bit % WORD)
        for place in _places(held.get(name, np.empty(0, _U))):
            word[place] |= one
        full.append(np.count_nonzero(word & one) / len(word))
    return Filters(languages, slots, np.array(full) ** HASHES)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of docs.

    A null text or one without a letter is `und` with score 0. A text with letters but no known n-gram gets the most
    frequent language with score 0, as does any text where no corrected count is above zero; if no language was learned,
    every text is `und`. Ties go to the more frequent language. Repeated rows give repeated results.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 2 ** SLOT_BITS slots for 64 languages, whatever the size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, score = held.value.classify(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, filters: Filters, text_col: str = "text", scored: bool = True, lang_col: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that have a language: not `und`, and if `scored` a score above zero.

    A text with letters and no known n-gram, as of another script or of a language that wasn't learned, has no score,
    but isn't `und`. The string column `lang_col`, if named, becomes the language found; a text without a score keeps what it has there.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            names, score = held.value.classify(batch.column(text_col))
            kept = pa.array((np.array(names) != UNKNOWN) & ((score > 0) | (not scored)))
            if lang_col:
                found = pc.if_else(pa.array(score > 0), pa.array(names, pa.string()), batch.column(lang_col).cast(pa.string()))
                batch = batch.set_column(batch.schema.get_field_index(lang_col), lang_col, found)
            yield batch.filter(kept)

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Column: the row's crc32 of the id as text leaves 1 modulo 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and predicts every row: doc_id, held_out, lang_pred, score."""
    filters = fit(docs.filter(~held_out()))
    return predict(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

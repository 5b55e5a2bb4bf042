"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts the subsequences of ORDER characters that both have, each weighted by DECAY to the power of
the length it spans in either word, and is normalised to 1 for equal words. A character put into an insult stretches
some subsequences by one, a gapped one keeps the rest, so such words stay close to the plain form.

Landmarks are words of the labelled training texts: those that set toxic texts apart, by log-likelihood ratio, and the
most frequent harmless words that are like them. A word's kernel values go through the inverse square root of the
landmarks' kernel matrix (the Nystroem map) to a linear SVM with squared hinge loss, trained on the labelled texts'
words, where a word stands on either side as often as toxic and clean texts have it. A text is read as the bag of its words' margins:
the three greatest, their sum, and the number of words go to a second linear SVM, trained on the labelled texts, whose
margin a sigmoid turns into the score. So one word that is only like an insult weighs less than two that are.
Characters of a word set apart by white space are read as one word too. Words of a few characters, which have few subsequences or none of ORDER, are read between
signs for their two ends as well, so a short insult is a landmark like a long one; words of over WIDTH characters are read in windows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import slices, stored

ORDER, DECAY = 4, 0.6
#: Toxic and harmless landmarks, and the kernel value from which a word is too close to one that was chosen, of either kind.
LANDMARKS, HARMLESS, CLOSE, EQUAL = 64, 32, 0.85, 0.98
#: Words of up to so many characters are framed by signs for their ends; those of fewer than ORDER are read only so.
SHORT, BEGIN, END = 4, "\x02", "\x03"
#: Share of a landmark's characters that a word must have in order for the kernel to be worked out; below, it counts as zero.
COMMON = 0.7
#: Kernel value from which a word is like a landmark, and how many such words the first machine is trained on.
LIKE, LIKES = 0.3, 6000
#: Characters of a word that the kernel reads at a time; longer words are read in windows that overlap by half.
WIDTH = 24
#: Labelled texts of either class that the model is fitted on; a bounded sample of labelled rows.
TRAIN = 3000
#: Candidates for landmarks that are sent to the driver, the texts they must be in, and words that a task remembers.
CANDIDATES, LEAST, MEMORY = 2000, 2, 300_000
#: Words whose kernel values are worked out at a time.
PART = 10_000

_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
_EDGES, _SIGNS = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"[\W_]+")


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(words), width), pad, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of the rows of two code tables; their padding must differ."""
    n, width, other = len(a), a.shape[1], b.shape[1]
    equal = (a[:, :, None] == b[:, None, :]).astype(np.float64)
    span = np.arange(other)
    reach = np.where(span[:, None] <= span[None, :], DECAY ** (span[None, :] - span[:, None]).clip(0), 0.0)
    before = np.ones((n, width + 1, other + 1))
    for _ in range(ORDER - 1):
        now = np.zeros_like(before)
        for i in range(width):
            now[:, i + 1, 1:] = DECAY * now[:, i, 1:] + DECAY**2 * (equal[:, i] * before[:, i, :-1]) @ reach
        before = now
    return DECAY**2 * (equal * before[:, :-1, :-1]).sum(axis=(1, 2))


def _own(words: list[str]) -> np.ndarray:
    """Square roots of the kernel of each word with itself."""
    out = np.zeros(len(words))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(-(-len(w) // 4) * 4, []).append(i)
    for width, at in by_length.items():
        for k in range(0, len(at), 2000):
            some = [words[i] for i in at[k : k + 2000]]
            out[at[k : k + 2000]] = np.sqrt(kernel(_codes(some, width, 0), _codes(some, width, -1)))
    return out


class Landmarks:
    """Kernel values of words against a fixed list of strings."""

    def __init__(self, strings: list[str]):
        self.strings, self.own = strings, _own(strings)
        self.codes = _codes(strings, max(map(len, strings), default=ORDER), -1)
        self.least = [max(ORDER, -(-len(s) * COMMON // 1)) for s in strings]
        self.letters = np.array(sorted({c for s in strings for c in map(ord, s)}), np.int32)
        self.masks = np.zeros((len(strings), len(self.letters) + 1), np.uint32)
        for k, s in enumerate(strings):
            for j, c in enumerate(map(ord, s)):
                self.masks[k, np.searchsorted(self.letters, c)] |= np.uint32(1 << j)

    def values(self, words: list[str]) -> np.ndarray:
        """len(words) x len(strings); words have WIDTH characters at most. The kernel is worked out for pairs with a common subsequence of
        ORDER characters, without which it is zero, and of a share COMMON of the landmark, without which it counts as zero."""
        out = np.zeros((len(words), len(self.strings)))
        by_length = np.argsort([len(w) for w in words], kind="stable")
        for start in range(0, len(words), 20_000):
            chosen = by_length[start : start + 20_000]
            some = [words[i] for i in chosen]
            codes = _codes(some, len(some[-1]), 0)
            at = np.searchsorted(self.letters, codes)
            at[self.letters[np.minimum(at, len(self.letters) - 1)] != codes] = len(self.letters)
            columns = np.ascontiguousarray(at.T)
            rows, marks = [], []
            for k in range(len(self.strings)):
                free = np.full(len(some), 2**32 - 1, np.uint32)
                for letters in columns:
                    hit = self.masks[k][letters] & free
                    free = (free + hit) | (free - hit)
                found = np.flatnonzero(np.bitwise_count(~free) >= self.least[k])
                rows.append(found)
                marks.append(np.full(len(found), k))
            rows, marks = np.concatenate(rows), np.concatenate(marks)
            near = np.unique(rows)
            norm = np.zeros(len(some))
            norm[near] = _own([some[i] for i in near])
            for k in range(0, len(rows), 4000):
                r, m = rows[k : k + 4000], marks[k : k + 4000]
                out[chosen[r], m] = kernel(codes[r], self.codes[m]) / (norm[r] * self.own[m])
        return out


@dataclass(frozen=True)
class Model:
    """beta and lift act on a word's Nystroem features; weights, bias, slope and shift on a text's bag of margins."""

    landmarks: list[str]
    nystroem: np.ndarray
    beta: np.ndarray
    lift: float
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, bags: np.ndarray) -> np.ndarray:
        margin = bags @ self.weights + self.bias
        return 1 / (1 + np.exp(np.clip(-(self.slope * margin + self.shift), -60, 60)))


def _framed(word: str) -> str:
    """A short word between signs for its ends, as many as make ORDER characters at least."""
    signs = max(1, -(-(ORDER - len(word)) // 2))
    return BEGIN * signs + word + END * signs


def _forms(token: str) -> list[str]:
    """What the kernel reads of a raw token: its middle part without outer signs, also without inner ones, in windows if it is long."""
    w = _EDGES.sub("", token)
    found = [w] if w.isalnum() else [w, _SIGNS.sub("", w)]
    found = [x for x in found if len(x) >= ORDER] + [_framed(x) for x in found if 0 < len(x) <= SHORT]
    return [y for x in found for y in ([x] if len(x) <= WIDTH else [x[i : i + WIDTH] for i in range(0, len(x) - WIDTH // 2, WIDTH // 2)])]


def _tokens(text: str) -> set[str]:
    text = text.lower()
    found = set(text.split())
    if len(text) >= 2 * ORDER - 1:
        found.update("".join(m.split()) for m in _SPACED.findall(text))
    return found


class Reader:
    """Bags of texts; remembers the words it has seen, as most come again: those with a margin, and of the many without one a 64-bit hash."""

    def __init__(self, model: Model):
        self.model, self.landmarks = model, Landmarks(model.landmarks)
        self.seen: dict[str, float] = {}
        self.plain: set[int] = set()

    def margins(self, words: list[str]) -> np.ndarray:
        """How far each word is above the margin of a clean one; 0 for words that are like no landmark."""
        values = self.landmarks.values(words)
        near = values.max(axis=1) >= LIKE
        out = np.zeros(len(words))
        out[near] = np.clip(values[near] @ self.model.nystroem @ self.model.beta + self.model.lift + 1, 0, 3)
        return out

    def bags(self, texts: list[str | None]) -> np.ndarray:
        tokens = [_tokens(t) if t else set() for t in texts]
        if len(self.seen) + len(self.plain) > MEMORY:
            self.seen, self.plain = {}, set()
        every = [t for t in set().union(*tokens) if t not in self.seen and hash(t) not in self.plain]
        for k in range(0, len(every), PART):
            new = every[k : k + PART]
            forms = [_forms(t) for t in new]
            flat = [f for fs in forms for f in fs]
            if flat:
                margin = self.margins(flat)
                owner = np.repeat(np.arange(len(new)), [len(f) for f in forms])
                for i in np.flatnonzero(margin):
                    self.seen[new[owner[i]]] = max(self.seen.get(new[owner[i]], 0.0), float(margin[i]))
            self.plain.update(hash(t) for t in new if t not in self.seen)
        out = np.zeros((len(texts), 5))
        for i, own in enumerate(tokens):
            top = sorted((self.seen[t] for t in own if t in self.seen), reverse=True)
            out[i, : min(3, len(top))] = top[:3]
            out[i, 3:] = np.log1p(sum(top)), np.log1p(len(own)) / 10
        return out


_readers: dict[str, Reader] = {}


def reader_of(model: Model | None) -> Reader | None:
    """The worker's reader of a model, which remembers words from one task to the next; one model at a time."""
    if model is None:
        return None
    if model.name not in _readers:
        _readers.clear()
        _readers[model.name] = Reader(model)
    return _readers[model.name]


def _counts(rows: DataFrame) -> DataFrame:
    """word, a (toxic texts that have it), b (clean ones) of words that a landmark can be."""
    word = F.regexp_replace(F.col("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    words = rows.select("id", "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).select("id", "toxic", word.alias("word"))
    n = F.length("word")
    framed = lambda signs: F.concat(F.lit(BEGIN * signs), "word", F.lit(END * signs))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - WIDTH // 2, F.lit(1)), F.lit(WIDTH // 2)), lambda i: F.substring("word", i, F.lit(WIDTH)))
    forms = F.when(n == 0, F.array().cast("array<string>")).when(n <= ORDER - 3, F.array(framed(2))).when(n < ORDER, F.array(framed(1))).when(n <= SHORT, F.array(F.col("word"), framed(1))).when(n <= WIDTH, F.array("word")).otherwise(windows)
    words = words.select("id", "toxic", F.explode(forms).alias("word")).distinct()
    return words.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))


def _candidates(counts: DataFrame, bad: int, good: int) -> list[str]:
    """Words by how much oftener toxic texts have them, the clearest first."""
    a, b = F.col("a"), F.col("b")
    mean = (a + b) / (bad + good)
    gain = a * F.log(a / (bad * mean)) + F.when(b > 0, b * F.log(b / (good * mean))).otherwise(0)
    kept = counts.filter((a >= LEAST) & (a * good > 3 * b * bad)).withColumn("gain", F.round(gain, 6))
    return [r["word"] for r in kept.orderBy(F.desc("gain"), "word").limit(CANDIDATES).collect()]


def _apart(words: list[str], kept: list[str], most: int, close: float) -> list[str]:
    """kept and the first `most` words of which none has a kernel value of `close` or more with one before it."""
    kept, room = list(kept), most
    own = dict(zip(words + kept, _own(words + kept), strict=True)) if words or kept else {}
    for w in words:
        if room == 0:
            break
        if kept:
            k = kernel(np.repeat(_codes([w], len(w), 0), len(kept), axis=0), _codes(kept, max(map(len, kept)), -1))
            if (k / (own[w] * np.array([own[x] for x in kept]))).max() >= close:
                continue
        kept.append(w)
        room -= 1
    return kept


def _like(counts: DataFrame, landmarks: list[str]) -> DataFrame:
    """The counted words that are like a landmark."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(landmarks)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(marks.values(batch.column("word").to_pylist()).max(axis=1) >= LIKE))

    return counts.mapInArrow(keep, counts.schema)


def _nystroem(strings: list[str]) -> np.ndarray:
    marks = Landmarks(strings)
    inner = np.array([kernel(np.repeat(_codes([s], len(s), 0), len(strings), axis=0), marks.codes) for s in strings]) / np.outer(marks.own, marks.own)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    return (vector / np.sqrt(np.maximum(value, 0.01))) @ vector.T


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by Newton steps. Each class weighs the same."""
    z, sign = np.hstack([x, np.ones((len(x), 1))]), np.where(y == 1, 1.0, -1.0)
    weight = weight / np.where(y == 1, weight[y == 1].sum(), weight[y == 0].sum()) * len(y) / 2
    w, keep = np.zeros(z.shape[1]), np.eye(z.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(60):
        inside = sign * (z @ w) < 1
        zi, ci = z[inside], cost * weight[inside]
        new = np.linalg.solve(keep + zi.T @ (zi * ci[:, None]), zi.T @ (ci * sign[inside]))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of a label over the margin, with smoothed goals."""
    bad, good = (y == 1).sum(), (y == 0).sum()
    m, goal = np.column_stack([margin, np.ones(len(margin))]), np.where(y == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    ab = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(-m @ ab, -60, 60)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2), m.T @ (p - goal))
        ab = ab - np.clip(step, -2, 2)
    return float(ab[0]), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> Model | None:
    """Fits on at most `train` texts of either class, the least by hash of their id.

    docs has doc_id and text, labels doc_id and toxic. Rows with a null id or label are left out, a null text counts as
    empty. If a class has no row or no word tells the classes apart there is no model, and every text gets the score 0.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    some = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(train) for c in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # at most 2 * train rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "id")
    rows = stored(rows, "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counts = stored(_counts(rows), "words")
    toxic = _apart(_candidates(counts, bad, good), [], LANDMARKS, CLOSE) if bad and good else []
    if not toxic:
        return None
    like = stored(_like(counts, toxic), "like")
    harmless = [r["word"] for r in like.filter(F.col("b") * bad > F.col("a") * good).orderBy(F.desc("b"), "word").limit(CANDIDATES).collect()]
    strings = _apart(harmless, toxic, HARMLESS, EQUAL)
    words = like.orderBy(F.desc(F.greatest(F.col("a") / bad, F.col("b") / good)), "word").limit(LIKES).toPandas()
    nystroem = _nystroem(strings)
    x = Landmarks(strings).values(words["word"].tolist()) @ nystroem
    y, weight = np.repeat([1, 0], len(words)), np.concatenate([words["a"], words["b"]]).astype(float)
    some = weight > 0
    if len(set(y[some])) < 2:  # no clean text has a word like a toxic one: any other text stands for them
        beta, lift = _machine(np.vstack([x, np.zeros((1, x.shape[1]))]), np.append(np.ones(len(words)), 0), np.append(words["a"] / bad, 1.0), 10.0)
    else:
        beta, lift = _machine(np.vstack([x, x])[some], y[some], weight[some], 300.0)
    draft = Model(strings, nystroem, beta, lift, np.zeros(5), 0.0, 0.0, 0.0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(draft)
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch.column("id"), batch.column("toxic"), pa.array(list(reader.bags(batch.column("text").to_pylist())))], ["id", "toxic", "x"])

    got = rows.select("id", "toxic", "text").mapInArrow(read, "id long, toxic int, x array<double>").toPandas().sort_values("id")
    bags, y = np.array(got["x"].tolist()), got["toxic"].to_numpy()
    weights, bias = _machine(bags, y, np.ones(len(y)), 10.0)
    slope, shift = _sigmoid(bags @ weights + bias, y)
    return Model(strings, nystroem, beta, lift, weights, bias, slope, shift)


def _scores(reader: Reader | None, texts: pa.Array) -> np.ndarray:
    return reader.model.scores(reader.bags(texts.to_pylist())) if reader else np.zeros(len(texts))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5) of every row; null and empty texts score as a text without words.

    Repeated rows give repeated results; an empty table gives an empty one; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # as many strings as landmarks and a matrix of their number squared

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(held.value)
        for batch in slices(batches, "text"):
            scores = _scores(reader, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(held.value)
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(_scores(reader, batch.column(text_col).cast(pa.string())) < 0.5))

    return docs.mapInArrow(read, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Column: the crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labels that aren't held out and scores every row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

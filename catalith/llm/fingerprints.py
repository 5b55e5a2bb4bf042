"""Document fingerprints from closed syncmers, in DataFrame functions only.

A window of K tokens is a closed syncmer if the least hash among its K - S + 1 inner windows of S tokens is the first or
the last of them. That depends on the window alone, never on its neighbours, so equal passages choose equal anchors
wherever they stand. The fingerprint holds every anchor of a text with its place, in the order of the places, however
long the text is. Two fingerprints are aligned by the distances of their anchors: an anchor is common to both if it has
the same hash and stands as far behind the anchor before it. The likeness is the Jaccard similarity of these sets.

Tokens are words (longer ones than WORD code points are cut), for texts of every length. Of K - S + 1 windows in a row at least
one is an anchor, so anchors stand at most that far apart. Texts of fewer than K words, and those of a few more in which no
window is an anchor, have one anchor at place 0: the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import runs, stored

K, S = 5, 2
WORD = 32
#: Rows that stand in one window when the next document is looked up, and such windows in one window of the second level.
RUN, RUNS = 1024, 4096


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once: a lambda's argument is bound, not repeated."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _anchors(tokens: Column) -> Column:
    """Hash `h` and place `at` of each closed syncmer of an array of tokens, by place."""
    inner = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))

    def chosen(m: Column) -> Column:
        # m[i] is the hash of tokens i and i + 1; a window of K tokens has m[i] .. m[i + K - S]
        first = F.slice(m, 1, F.size(m) - (K - S))

        def anchor(a: Column, i: Column) -> Column:
            edge, middle = F.least(a, F.get(m, i + (K - S))), F.least(*[F.get(m, i + j) for j in range(1, K - S)])
            return F.when(edge <= middle, F.struct(F.xxhash64(a, F.get(m, i + S), F.get(m, i + (K - S))).alias("h"), i.alias("at")))

        return F.filter(F.transform(first, anchor), lambda x: x.isNotNull())

    few = F.array(F.struct(F.xxhash64(F.array_join(tokens, "\u0000"), F.size(tokens)).alias("h"), F.lit(0).alias("at")))
    full = _let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: _let(inner(h), chosen))
    some = _let(full, lambda found: F.when(F.size(found) == 0, few).otherwise(found))
    return F.when(F.size(tokens) == 0, F.array().cast("array<struct<h: bigint, at: int>>")).when(F.size(tokens) < K, few).otherwise(some)


def sketch(text: Column) -> Column:
    """Struct with the anchors `w` of a text's words. text must not be null."""
    cut = F.regexp_replace(text, r"([^\x20\x09-\x0D]{%d})(?=[^\x20\x09-\x0D])" % WORD, "$1 ")
    words = F.filter(F.split(cut, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.struct(_let(words, _anchors).alias("w"))


def as_text(s: Column) -> Column:
    """The fingerprint as text: for each anchor 8 hexadecimal digits, the lower half of its hash, and one for how far it stands behind the anchor before it."""
    digits = lambda x: F.array_join(F.transform(x, lambda v, i: F.concat(F.lpad(F.hex(v["h"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.hex((v["at"] - F.coalesce(F.get(x, i - 1)["at"], F.lit(0))).cast("long")))), "")
    return F.lower(digits(s["w"]))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of the aligned anchors of both that are in both; 1 if both are empty, null if either is null."""

    def aligned(x: Column) -> Column:
        return F.array_distinct(F.transform(x, lambda v, i: F.xxhash64(v["h"], v["at"] - F.get(x, i - 1)["at"])))

    def share(x: Column, y: Column) -> Column:
        common = lambda u, v: _let(F.size(F.array_intersect(u, v)), lambda n: n / (F.size(u) + F.size(v) - n))
        return F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(_let(aligned(x), lambda u: _let(aligned(y), lambda v: common(u, v))))

    return share(a["w"], b["w"])


def with_next(docs: DataFrame) -> DataFrame:
    """docs with `next`, a struct of all its columns in the following row by (doc_id, tie); after the last row, the first.

    docs has doc_id, text and tie. Rows are cut into runs of about RUN rows (see runs()), and the first row of each run,
    found by an aggregate, is also put behind the last row of the run before. So one exchange by run brings every row and
    its successor together, whatever the ids are. The run before is found in windows of RUNS runs, whose own order has a
    row for each RUN * RUNS rows, few enough to sort in one task.
    """
    rows = docs.withColumn("_run", runs(docs, RUN))
    firsts = stored(rows.groupBy("_run").agg(F.min_by(F.struct("doc_id", "text", "tie"), F.struct("doc_id", "tie")).alias("first")), "firsts")
    numbers = firsts.select("_run", F.floor(F.col("_run") / RUNS).alias("_part"))
    parts = numbers.groupBy("_part").agg(F.max("_run").alias("_high"))
    parts = parts.select("_part", F.lag("_high").over(Window.orderBy("_part")).alias("_before"))
    last = numbers.agg(F.max("_run")).first()[0]
    inside = F.lag("_run").over(Window.partitionBy("_part").orderBy("_run"))
    back = numbers.withColumn("_then", inside).join(parts, "_part").select("_run", F.coalesce("_then", "_before", F.lit(last)).alias("_to"))
    sent = firsts.join(back, "_run").select("first.*", F.col("_to").alias("_run"), F.lit(1).alias("_sent"))
    every = rows.withColumn("_sent", F.lit(0)).unionByName(sent)
    columns = [c for c in every.columns if c not in ("_run", "_sent")]
    order = Window.partitionBy("_run").orderBy("_sent", F.col("doc_id").asc_nulls_first(), "tie")
    return every.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("_sent = 0").drop("_run", "_sent")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, text, sketch (see sketch()) and fingerprint of every row. A null text counts as empty.

    An empty text has an empty sketch. Equal texts have equal fingerprints. Repeated rows give repeated results; an
    empty table gives an empty one; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", sketch(F.col("text")).alias("sketch")).withColumn("fingerprint", as_text(F.col("sketch")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document by ascending doc_id (null ids come first, equal ids by hash of the text; after the last the first). A single document is its
    own next. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    # sketches are made behind the exchange, which then carries the texts alone; a text is sketched again as the next one
    both = with_next(rows).withColumns({"n_chars": F.length("text").cast("long"), "sketch": sketch(F.col("text")), "after": sketch(F.col("next.text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = both.select("doc_id", "n_chars", "sketch", "after", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "sketch", "after", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("changed"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("changed")).alias("near_edited"), likeness(F.col("sketch"), F.col("after")).alias("near_next"))

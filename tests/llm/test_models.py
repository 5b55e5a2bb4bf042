"""What the learned operators must find whatever the words' length and however texts repeat."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalith.llm import language_id, toxicity

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "sur", "tan") for b in ("ra", "ne", "vol", "di") for c in ("", "to", "mer", "s")] + ["is", "we", "the", "at", "of", "a"]


@pytest.mark.parametrize("insult", ["qix", "zz", "krogl", "wurfelquatschkopfnase", "abscheulichkeitsverbreitungsmaschine"])
def test_insults_of_any_length(spark, insult):
    """Texts are toxic through one insult; held-out ones are found, plain and with a character put in, and clean ones are left."""
    rng = random.Random(1)
    texts = [[rng.choice(WORDS) for _ in range(rng.randrange(5, 40))] for _ in range(500)]
    rows = []
    for i, words in enumerate(texts):
        if toxic := i % 2:
            words.insert(rng.randrange(len(words)), insult.upper() if i % 3 else insult + "!")
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect()}
    wrong = [i for i, _, t in rows if got[i]["predicted"] != t]
    assert len([i for i in wrong if got[i]["held_out"]]) <= 2 and len(wrong) <= 5
    if len(insult) > 4:
        put = insult[:2] + "-" + insult[2:]
        some = spark.createDataFrame([(1, f"{' '.join(texts[0])} {put}")], "doc_id long, text string")
        assert toxicity.score(some, toxicity.fit(docs, labels)).first()["predicted"] == 1


def test_repeated_toxic_rows_and_repeated_labels(spark):
    rows = [(i, "baratos kenemer qix" if i % 2 else "baratos kenemer lodis", i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows + rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows + rows], "doc_id long, toxic int")
    assert {(r["doc_id"] % 2, r["predicted"]) for r in toxicity.detect(docs, labels).collect()} == {(0, 0), (1, 1)}


def test_a_language_of_one_text_is_learned(spark):
    """However often a language's only text repeats, it is learned, with ids and without."""
    german = "der schnelle braune fuchs springt über den faulen hund und läuft davon"
    english = ["the quick brown fox jumps over the lazy dog and runs away", "a dog of the house is in the garden with the children"]
    rows = [(i, german, "de") for i in range(30_000)] + [(50_000 + i, english[i % 2], "en") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for known in (df, df.drop("doc_id")):
        filters = language_id.fit(known)
        assert set(filters.languages) == {"de", "en"}
        got = language_id.predict(df, filters).groupBy("lang_pred").agg(F.count("*").alias("n"), F.min("score").alias("low")).collect()
        assert {r["lang_pred"]: r["n"] for r in got} == {"de": 30_000, "en": 100} and min(r["low"] for r in got) > 0.5


def test_pipeline_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words stand here now"), (None, "x y")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("_row", "_row_", "component_id", "kept", "n_shingles", "id")})
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "None"]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0

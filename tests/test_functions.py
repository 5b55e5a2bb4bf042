"""Text functions and similarities on cases with known results, and their invariants."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from test_resolution import basic, drawn_names

from catalith.functions import similarity as S
from catalith.functions import text as T


def value(spark, column, **given):
    df = spark.range(1)
    for k, v in given.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("v")).first()["v"]



@pytest.mark.parametrize(("given", "wanted"), [("  A  b\tC ", "a b c"), ("", ""), ("x", "x")])
def test_normalised(spark, given, wanted):
    assert value(spark, T.normalised(F.lit(given))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [
    ("\u201Chi\u201D \u2013 it\u2019s\u2026", '"hi" - it\'s...'), ("a\u200Bb\u200E\u200Fc\u00AD", "abc"), ("x\u2014y\u2015z\u2212w", "x--y--z-w"), ("\u2012\u00B4\u2060", "\u2012\u00B4\u2060"),
    ("p\u2028q\u2029r", "p\nq\nr"), ("\u00A0a\u3000", " a "), (" \tkeeps \n", " \tkeeps \n"), ("\u00ABq\u00BB\u2033", '"q""'), ("`code`", "`code`"), (None, ""), ("", ""),
    (r"\*bold\*", "*bold*"), (r"\\*x", r"\*x"), (r"a\|b \$", r"a\|b \$"), (r"\~\`\[\]\(\)\#\+\-\!\.\>\_", "~`[]()#+-!.>_"),
])
def test_sanitised(spark, given, wanted):
    assert value(spark, T.sanitised(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize("given", drawn_names(8, 12))
def test_basic(spark, given):
    assert value(spark, T.basic(F.lit(given))) == basic(given)


def test_slug_and_fallback(spark):
    assert value(spark, T.slug(F.lit("Árvíztűrő  Gép!"))) == "arvizturo-gep"
    assert value(spark, T.slug(F.lit("???"), F.lit("abc123456"))) == "123456"


def test_digit_words(spark):
    rng = random.Random(2)
    for _ in range(12):
        brand, words = "Acme", [rng.choice(["plain", "wide", "K7", "12-x", "Q.9", "z"]) for _ in range(rng.randrange(1, 4))]
        plain = [re.sub("[^a-z0-9]", "", w.lower()) for w in words]
        digits = [w for w in plain if re.search("[0-9]", w)]
        longest = max(enumerate(words), key=lambda w: (len(w[1]), -w[0]))[0]
        named = rng.choice(["", "Acme ", "ACME "]) + " ".join(words)
        assert value(spark, T.digit_words(F.lit(named), F.lit(brand))) == (" ".join(digits) if digits else plain[longest])


def test_tokens(spark):
    for name in drawn_names(9, 12):
        words = re.findall("[a-z]+|[0-9]+", name.lower())
        first = next((i for i, w in enumerate(words) if w.isdigit()), len(words))
        assert value(spark, T.tokens(F.lit(name))) == words
        assert value(spark, T.critical_alphas(F.lit(name))) == [a for a, b in itertools.pairwise(words) if a.isalpha() and b.isdigit()]
        assert value(spark, T.suffix_alphas(F.lit(name))) == [w for w in words[first:] if w.isalpha()]


def test_trigram_similarity(spark):
    assert value(spark, S.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert value(spark, S.trigram_similarity(F.lit("abc"), F.lit("abc"))) == 1
    assert value(spark, S.trigram_similarity(F.lit(""), F.lit("abc"))) == 0


def test_dice_and_prefix(spark):
    assert value(spark, S.bigram_dice(F.lit("night"), F.lit("nacht"))) == pytest.approx(0.25)
    assert value(spark, S.bigram_dice(F.lit("a"), F.lit("b"))) == 0
    assert value(spark, S.prefix_words(F.lit("gaming mon"), F.lit("gaming monitors"))) == 1


def test_in_source(spark):
    s = F.lit("The fork, made of carbon, is light and the frame is steel.")
    assert value(spark, T.in_source(F.lit("made of carbon"), s))
    assert value(spark, T.in_source(F.lit("steel fork"), s))
    assert value(spark, T.in_source(F.lit("fork made of carbon is light"), s))
    assert not value(spark, T.in_source(F.lit("fork made of steel is light"), s))


def test_numbers_booleans_links(spark):
    assert value(spark, T.standalone_number(F.lit("240Hz"))) == 240
    assert value(spark, T.standalone_number(F.lit("2 x 3"))) is None
    assert value(spark, T.to_boolean(F.lit(" Yes "))) is True
    assert value(spark, T.to_boolean(F.lit("maybe"))) is None
    assert value(spark, T.domain(F.lit("https://www.Shop.example.com/a"))) == "shop.example.com"
    assert value(spark, T.url_key(F.lit("https://A.example/p//"))) == "https://a.example/p"

"""Repeated passages against a plain count of windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import substring_dedup

SCHEMA = "doc_id long, text string"


def plain(rows, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    starts = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, docs, strict=True):
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(map(str, out))


def found(spark, rows, window):
    clash = ("k1", "k2", "key", "words", "low", "high", "first", "n", "spans", "kept", "some", "at")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in clash})
    return sorted(map(str, map(tuple, substring_dedup.remove_repeats(df, window).collect())))


def corpus(seed, n=120):
    """Texts of own words, quotes of common passages at any place, near copies, equal rows, periodic texts and odd ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "The", "the", "über", "x" * 30]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.choice([34, 35, 36, 60, 150]))] for _ in range(8)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.25:
            words = list(rng.choice(texts))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(rng.choice([1, 10, 34, 35, 80, 200]))]
            for _ in range(rng.randrange(3)):
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                at = rng.randrange(len(words))
                words[at:at] = p[a : a + rng.randrange(1, len(p) + 1)] if rng.random() < 0.5 else p
        texts.append(words)
    rows = [(i, rng.choice([" ", "\n", " \t\r\n", "\x0b\x0c"]).join(w)) for i, w in enumerate(texts)]
    rows += rows[:3] + [(None, rows[5][1]), (7, rows[8][1]), (900, None), (901, ""), (902, " \n "), (903, "é " * 700), (904, "p q r " * 90), (905, "u v w " * 20)]
    return rows


@pytest.mark.parametrize(("seed", "window"), [(1, 35), (2, 35), (3, 12), (4, 3)])
def test_against_a_plain_count(spark, seed, window):
    rows = corpus(seed)
    want = plain(rows, window)
    assert found(spark, rows, window) == want
    assert sum(" 0, '" not in x for x in want) > 20


def test_keys_with_many_regions(spark, monkeypatch):
    """Keys that are split by window, and many blocks, give the same rows."""
    monkeypatch.setattr(substring_dedup, "DEEP", 2)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 50)
    rows = corpus(9)
    assert found(spark, rows, 35) == plain(rows, 35)


def test_one_passage_in_many_surroundings(spark):
    rng = random.Random(4)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = own(40)
    rows = [(i, " ".join(own(20) + passage + own(20))) for i in range(700)]
    assert found(spark, rows, 35) == plain(rows, 35)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c"), (1, "a b c")], [(1, " ".join(map(str, range(35))))]])
def test_small_tables(spark, rows):
    assert found(spark, rows, 35) == plain(rows, 35)


def test_longest_elsewhere():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.integers(0, 3, rng.integers(1, 40))
        longest = substring_dedup.longest_elsewhere(s, len(s) + 1)
        for i in range(len(s)):
            want = max((next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), len(s)) for j in range(len(s)) if j != i), default=0)
            assert longest[i] == want

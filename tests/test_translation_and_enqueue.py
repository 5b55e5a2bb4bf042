"""Batches of translations against a plain walk over dictionary, cache and answers; re-sync requests and the queue by case table."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalith.operators import enqueue as Q
from catalith.operators import translation as T

PAIR = "text string, translation string"


def texts(spark, some):
    return spark.createDataFrame([(t,) for t in some], "text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_a_plain_walk(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    dictionary = {w: f"d-{w}" for w in words[:3]}
    known = {w: f"m-{w}" for w in words[2:11]}
    cache, held = T.cache_table(spark, str(tmp_path / "cache"), buckets=3), {}
    for number in range(4):
        now = datetime(2020, 1, 1) + timedelta(days=2 * number)
        given = [rng.choice([w, f" {w.upper()}\t"]) for w in rng.choices(words, k=10)] + [None, "", "  ", " 12,5", "-3", "."]
        enabled = number != 2
        call = lambda n: T.translate_batch(
            texts(spark, given), n, ("en", "hu"), spark.createDataFrame(list(dictionary.items()), PAIR), cache, spark.createDataFrame(list(known.items()), PAIR), F.lit(str(now)).cast("timestamp_ntz"), ttl_days=3, enabled=enabled
        )
        got = call(number)
        want = {}
        for key in {(t or "").strip().lower() for t in given} - {"", "12,5", "-3"}:
            live = key in held and held[key][2] > now
            if key in dictionary:
                want[key] = (dictionary[key], "dictionary")
            elif live:
                want[key] = (held[key][0], "cache")
                held[key] = (held[key][0], held[key][1] + 1, held[key][2])
            elif key in known and enabled:
                want[key] = (known[key], "llm")
                held[key] = (known[key], 0, now + timedelta(days=3))
            else:
                want[key] = (None, "untranslated")
        assert {r["text"]: (r["translation"], r["origin"]) for r in got.collect()} == want
        stats = T.batch_stats(texts(spark, given), got).first()
        assert (stats["given"], stats["different"]) == (len(given), len(want))
        assert [stats[o] for o in T.ORIGINS] == [sum(v[1] == o for v in want.values()) for o in T.ORIGINS]
        shown = T.with_translations(texts(spark, given), "text", got, ("en", "hu")).collect()
        for r in shown:
            plain = None if r["text"] is None else r["text"].strip()
            assert r["translated"] == (plain if plain is None or plain.lower() not in want else want[plain.lower()][0] or plain)
        call(number)  # the batch again: nothing changes
        assert {r["text"]: (r["translation"], r["hits"], r["expires_at"]) for r in cache.read().collect()} == held


def test_translation_without_need_or_rows(spark, tmp_path):
    cache = T.cache_table(spark, str(tmp_path / "cache"))
    none, now = spark.createDataFrame([], PAIR), F.lit("2020-01-01").cast("timestamp_ntz")
    same = T.translate_batch(texts(spark, ["a", " B "]), 0, ("en", "en"), none, cache, none, now)
    assert same.count() == 0 and cache.read().count() == 0
    assert sorted(r["translated"] for r in T.with_translations(texts(spark, ["a", " B "]), "text", same, ("en", "en")).collect()) == ["B", "a"]
    empty = T.translate_batch(texts(spark, []), 1, ("en", "hu"), none, cache, none, now)
    assert tuple(T.batch_stats(texts(spark, []), empty).first()) == (0,) * 6


def test_resync_requests_and_queue(spark, tmp_path):
    records = spark.createDataFrame([(1, 10, 5, "u1"), (2, 10, None, "u2"), (3, 10, 5, None), (4, 10, 5, ""), (5, None, 5, "u5"), (6, 11, None, None)], "record_id long, product_id long, source_id long, url string")
    asked = [("a", 1, 10, True), ("b", 1, 11, None), ("c", 2, 10, None), ("d", 3, 10, None), ("e", 4, 10, None), ("f", 5, 10, None), ("g", 99, 10, None), ("h", None, 10, None), ("i", 1, 10, None), ("j", 6, 11, None), ("k", 1, None, None)]
    checked = Q.resync_requests(spark.createDataFrame(asked, "request_id string, record_id long, product_id long, force boolean"), records)
    got = {r["request_id"]: r["outcome"] for r in checked.collect()}
    assert got == {"a": "queued", "b": "not found", "c": "manual source", "d": "missing url", "e": "missing url", "f": "not found", "g": "not found", "h": "not found", "i": "queued", "j": "manual source", "k": "not found"}
    queue = Q.task_table(spark, str(tmp_path / "queue"), buckets=2)
    assert Q.enqueue(queue, Q.resync_tasks(checked), 0) and not Q.enqueue(queue, Q.resync_tasks(checked), 0)
    rows = {r["task_id"]: r.asDict() for r in queue.read().collect()}
    assert {k: (r["status"], r["force"], r["attempts"], r["url"], r["queue"]) for k, r in rows.items()} == {"a": ("pending", True, 0, "u1", "detail"), "i": ("pending", False, 0, "u1", "detail")}
    again = spark.createDataFrame([("a", "list", "failed")], "task_id string, queue string, status string")
    assert Q.enqueue(queue, again, 1)
    assert {r["task_id"]: (r["queue"], r["status"], r["attempts"], r["url"]) for r in queue.read().collect()}["a"] == ("list", "pending", 0, "u1")

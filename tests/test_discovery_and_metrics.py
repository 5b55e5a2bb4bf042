"""Discovery against a plain walk, and metrics that equal counts of the runs they were made in."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalith.sources.measured import Metrics
from catalith.streaming.discovery import HITS, discover, task_table

RULES = [(r"/p/\d", "detail"), (r"/list/", "list")]


def hits(rng, n):
    paths = [lambda: f"/p/{rng.randrange(12)}", lambda: f"/P/{rng.randrange(12)}/", lambda: f"/list/{rng.randrange(4)}", lambda: "/about"]
    return [(rng.randrange(4), rng.choice([None, "https://a.example" + rng.choice(paths)(), "HTTPS://A.example" + rng.choice(paths)()])) for _ in range(n)]


@pytest.mark.parametrize("links", [False, True])
def test_discovery(spark, tmp_path, links):
    rng = random.Random(4)
    folder, target = f"{tmp_path}/in", task_table(spark, f"{tmp_path}/tasks", 4)
    sources = spark.createDataFrame([(0, True), (1, True), (2, False)], "source_id long, enabled boolean")
    records = [("https://A.EXAMPLE/p/3/",), ("https://a.example/p/7",)]
    known, want, emitted = {"https://a.example/p/3", "https://a.example/p/7"}, {}, []
    run = lambda: discover(spark, folder, f"{tmp_path}/c", target, sources, spark.createDataFrame(records, "url string"), RULES, links)
    for k in range(3):
        rows = hits(rng, 30)
        spark.createDataFrame(rows, HITS).coalesce(1).write.mode("append").parquet(folder)
        new = {}
        for s, u in rows:
            if s in (0, 1) and u is not None and not u.endswith("about"):
                key = u.lower().rstrip("/")
                queue = "detail" if "/p/" in u else "list" if "/list/" in u else None
                new.setdefault(key, []).append((u, s, queue))
        fresh = {}
        for key, some in new.items():
            u, s, queue = min(some)
            if key not in want and (links or key not in known) and queue:
                fresh[key] = (u, s, queue)
        want |= fresh
        assert run() == len(fresh)
        emitted.append(len(fresh))
    assert {r["key"]: (r["url"], r["source_id"], r["queue"]) for r in target.read().collect()} == want and sum(emitted) > 6
    assert run() == 0
    # a task that is done is no longer under way, so a hit on it counts again
    done = next(iter(want))
    target.merge(spark.createDataFrame([(done, "done")], "key string, status string"), 99)
    other = task_table(spark, f"{tmp_path}/tasks", 4)
    assert other.read().filter("status = 'done'").count() == 1


def test_metrics_equal_counts_of_the_runs(spark, tmp_path):
    metrics = Metrics(spark, f"{tmp_path}/m")
    for run, rows in enumerate(([(1, 2.0), (2, None)], [(1, 5.0), (1, 1.0), (3, 4.0)], [])):
        df = spark.createDataFrame(rows, "k int, v double")
        out, seen = metrics.observed(df, "load", {"rows": F.count("*"), "ones": F.count_if(F.col("k") == 1)}, {"greatest": F.max("v")})
        out.write.parquet(f"{tmp_path}/out{run}")
        got = seen.keep(f"r{run}", f"2024-01-0{run + 1} 00:00:00")
        assert got == {"rows": len(rows), "ones": sum(k == 1 for k, _ in rows), "greatest": max((v for _, v in rows if v is not None), default=0)}
        if run == 1:
            seen.keep("r1", "2024-01-02 00:00:00")  # given again
    assert {(r["metric"], r["kind"]): r["value"] for r in metrics.totals().collect()} == {("rows", "counter"): 5, ("ones", "counter"): 3, ("greatest", "gauge"): 0}
    assert metrics.read().count() == 9
    assert sorted(r["line"] for r in metrics.text().collect()) == ['greatest{step="load"} 0', 'ones_total{step="load"} 3', 'rows_total{step="load"} 5']

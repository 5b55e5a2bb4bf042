"""Work-queue analytics: claims under concurrency and rate limits, depth, health, transitions, schedules, metrics.

Instead of one claim for each poll, a batch ranks every claimable task of a source and reports those that could start now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.plans.catalogue import with_sql
from catalith.plans.define import Plans
from catalith.sources.tables import PRODUCT_SQL, RECORD_SQL, SOURCE_SQL, TASK_SQL, products, source_records, sources, table, tasks

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

NOW = "2024-01-20 12:00:00"
STALE_MINUTES, MAX_ATTEMPTS, DEFAULT_RATE = 240, 3, 50

CLAIM_SQL = f"""{TASK_SQL}, {SOURCE_SQL},
st AS (SELECT *, TIMESTAMP '{NOW}' AS now, created_at <= TIMESTAMP '{NOW}' AS seen FROM task),
held AS (SELECT source_id, count(*) FILTER (WHERE status = 'processing' AND locked_at >= now - INTERVAL 240 MINUTE) AS inflight, max(locked_at) AS last_lock FROM st WHERE seen GROUP BY 1),
shop AS (SELECT seller_id, count(*) FILTER (WHERE status = 'processing' AND locked_at >= now - INTERVAL 240 MINUTE) AS inflight FROM st WHERE seen GROUP BY 1),
claim AS (SELECT t.*, s.enabled, s.max_concurrent, s.requests_per_hour, coalesce(h.inflight, 0) AS inflight, h.last_lock, coalesce(p.inflight, 0) AS seller_inflight,
  (status = 'pending' OR status = 'failed' AND attempts < 3 OR status = 'processing' AND locked_at < now - INTERVAL 240 MINUTE) AS claimable, (scheduled_at IS NULL OR scheduled_at <= now) AS due,
  coalesce(h.inflight, 0) < coalesce(s.max_concurrent, 1) AS room, (h.last_lock IS NULL OR epoch(now) - epoch(h.last_lock) >= 3600 // coalesce(s.requests_per_hour, 50)) AS slow, coalesce(p.inflight, 0) < 30 AS seller_room
  FROM st t JOIN source s ON s.id = t.source_id LEFT JOIN held h ON h.source_id = t.source_id LEFT JOIN shop p ON p.seller_id = t.seller_id WHERE seen)"""


def gates(spark, sf) -> DataFrame:
    """Every task seen so far with its gates as booleans: claimable, due, enabled, room, slow, seller_room."""
    now = F.lit(NOW).cast("timestamp_ntz")
    t = tasks(spark, sf).filter(F.col("created_at") <= now).withColumn("now", now)
    fresh = F.col("locked_at") >= F.col("now") - F.expr(f"interval {STALE_MINUTES} minutes")
    running = F.count_if((F.col("status") == "processing") & fresh)
    held = t.groupBy("source_id").agg(running.alias("inflight"), F.max("locked_at").alias("last_lock"))
    shop = t.groupBy("seller_id").agg(running.alias("seller_inflight"))
    s = sources(spark, sf).select(F.col("id").alias("source_id"), "enabled", "max_concurrent", "requests_per_hour")
    seconds = lambda x: F.unix_seconds(F.col(x).cast("timestamp"))
    every = F.floor(F.lit(3600) / F.coalesce("requests_per_hour", F.lit(DEFAULT_RATE)))
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp")) / 1e6
    return (
        t.join(s, "source_id").join(held, "source_id", "left").join(shop, "seller_id", "left")
        .withColumn("claimable", (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < MAX_ATTEMPTS)) | ((F.col("status") == "processing") & ~fresh))
        .withColumn("due", F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= F.col("now")))
        .withColumn("room", F.col("inflight") < F.coalesce("max_concurrent", F.lit(1)))
        .withColumn("slow", F.col("last_lock").isNull() | (micros("now") - micros("last_lock") >= every))
        .withColumn("seller_room", F.coalesce("seller_inflight", F.lit(0)) < 30)
    )


@P.query(f"""WITH {CLAIM_SQL} SELECT id, source_id, queue FROM claim WHERE claimable AND due AND enabled AND room AND slow AND seller_room AND queue IN ('list', 'detail')
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at, id) = 1""")
def t1_t6_claims(spark, sf):
    oldest = Window.partitionBy("source_id").orderBy("created_at", "id")
    ok = gates(spark, sf).filter("claimable and due and enabled and room and slow and seller_room and queue in ('list', 'detail')")
    return ok.withColumn("place", F.row_number().over(oldest)).filter("place = 1").select("id", "source_id", "queue")


@P.query(f"WITH {CLAIM_SQL} SELECT id FROM claim WHERE claimable AND due AND inflight <= 3 ORDER BY created_at, id LIMIT 1")
def t7_general_queue(spark, sf):
    """The general queue starts a task while at most three are in flight."""
    return gates(spark, sf).filter("claimable and due and inflight <= 3").orderBy("created_at", "id").select("id").limit(1)


@P.query(f"""WITH {CLAIM_SQL}, r AS (SELECT id, list_filter([CASE WHEN NOT due THEN 'not due' END, CASE WHEN NOT enabled THEN 'source disabled' END, CASE WHEN NOT room THEN 'concurrency' END, CASE WHEN NOT slow THEN 'rate' END, CASE WHEN NOT seller_room THEN 'seller concurrency' END], lambda x: x IS NOT NULL) AS reasons, created_at FROM claim WHERE claimable)
SELECT id, reasons FROM r WHERE len(reasons) > 0 ORDER BY created_at, id LIMIT 20""")
def t8_no_claim_reasons(spark, sf):
    named = [("due", "not due"), ("enabled", "source disabled"), ("room", "concurrency"), ("slow", "rate"), ("seller_room", "seller concurrency")]
    reasons = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(name)) for c, name in named]))
    return gates(spark, sf).filter("claimable").withColumn("reasons", reasons).filter(F.size("reasons") > 0).orderBy("created_at", "id").limit(20).select("id", "reasons")


@P.query(f"""{with_sql(TASK_SQL)} SELECT id, CASE WHEN id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN id % 2 = 0 THEN attempts ELSE attempts + 1 END::INTEGER AS attempts,
CASE WHEN id % 2 = 1 THEN locked_at + INTERVAL 1 MINUTE * least(2 ** (attempts + 1), 60)::INTEGER END AS scheduled_at FROM task WHERE status = 'processing'""")
def t9_transitions(spark, sf):
    """Even tasks succeed; the others fail and wait min(2^attempts, 60) minutes."""
    ok, tries = F.col("id") % 2 == 0, F.col("attempts") + F.when(F.col("id") % 2 == 0, 0).otherwise(1)
    wait = F.make_dt_interval(mins=F.least(F.pow(F.lit(2), tries), F.lit(60)).cast("int"))
    return tasks(spark, sf).filter("status = 'processing'").select("id", F.when(ok, "completed").otherwise("failed").alias("status"), tries.alias("attempts"), F.when(~ok, F.col("locked_at") + wait).alias("scheduled_at"))


@P.query(f"""{with_sql(SOURCE_SQL)}, s AS (SELECT id, CASE WHEN id % 3 = 0 THEN 1440 END AS full_minutes, CASE WHEN id % 2 = 0 THEN 60 END AS delta_minutes, CASE WHEN id % 6 <> 0 THEN TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE * (id % 11 - 5)::INTEGER END AS next_run FROM source WHERE enabled),
d AS (SELECT id, 'full' AS mode, full_minutes AS m, next_run FROM s UNION ALL SELECT id, 'incremental', delta_minutes, next_run FROM s)
SELECT id, mode, TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE * m::INTEGER AS next FROM d WHERE m IS NOT NULL AND (next_run IS NULL OR next_run <= TIMESTAMP '{NOW}')""")
def t10_p20_due_sources(spark, sf):
    now = F.lit(NOW).cast("timestamp_ntz")
    when = F.when(F.col("id") % 6 != 0, now + F.make_dt_interval(mins=(F.col("id") % 11 - 5).cast("int")))
    s = sources(spark, sf).filter("enabled").select("id", when.alias("next_run"), F.explode(F.array(F.struct(F.lit("full").alias("mode"), F.when(F.col("id") % 3 == 0, 1440).alias("m")), F.struct(F.lit("incremental").alias("mode"), F.when(F.col("id") % 2 == 0, 60).alias("m")))).alias("d"))
    return s.filter(F.col("d.m").isNotNull() & (F.col("next_run").isNull() | (F.col("next_run") <= now))).select("id", "d.mode", (now + F.make_dt_interval(mins=F.col("d.m"))).alias("next"))


@P.query(f"""{with_sql(RECORD_SQL, TASK_SQL)}, hit AS (SELECT DISTINCT url, model_id, source_id FROM record WHERE source_id % 3 = 0)
SELECT url, CASE WHEN model_id % 2 = 0 THEN 'detail' ELSE 'list' END AS queue FROM hit WHERE source_id NOT IN (SELECT source_id FROM task WHERE status = 'failed') AND url NOT IN (SELECT url FROM record WHERE flag = 'R')""")
def t12_incremental_sync(spark, sf):
    """Distinct hits, classified, without known records and failing sources."""
    r = source_records(spark, sf)
    hit = r.filter("source_id % 3 = 0").select("url", "model_id", "source_id").distinct()
    bad = tasks(spark, sf).filter("status = 'failed'").select("source_id").distinct()
    fresh = hit.join(bad, "source_id", "left_anti").join(r.filter("flag = 'R'").select("url").distinct(), "url", "left_anti")
    return fresh.select("url", F.when(F.col("model_id") % 2 == 0, "detail").otherwise("list").alias("queue"))


@P.query(f"""{with_sql(PRODUCT_SQL)}, f AS (SELECT id, unnest(['search', 'embed']) AS job FROM product WHERE category = 'PROMO')
SELECT id, job, CASE WHEN job = 'embed' AND id % 4 = 0 THEN 'already queued' WHEN id % 7 = 0 THEN 'disabled' ELSE 'queued' END AS outcome FROM f""")
def t14_fan_out(spark, sf):
    f = products(spark, sf).filter("category = 'PROMO'").select("id", "enabled", F.explode(F.array(F.lit("search"), F.lit("embed"))).alias("job"))
    queued = products(spark, sf).filter("id % 4 = 0").select("id", F.lit("embed").alias("job"), F.lit(True).alias("queued"))
    return f.join(queued, ["id", "job"], "left").select("id", "job", F.when(F.coalesce("queued", F.lit(False)), "already queued").when(~F.col("enabled"), "disabled").otherwise("queued").alias("outcome"))


@P.query(f"{with_sql(TASK_SQL)} SELECT queue, source_id, status, count(*) AS n FROM task WHERE status IN ('pending', 'processing', 'failed') GROUP BY ALL")
def a11_queue_depth(spark, sf):
    return tasks(spark, sf).filter(F.col("status").isin("pending", "processing", "failed")).groupBy("queue", "source_id", "status").agg(F.count("*").alias("n"))


@P.query(f"""{with_sql(TASK_SQL)} SELECT queue, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'failed') AS failed,
count(*) FILTER (WHERE status = 'completed') AS completed, max(created_at) AS newest FROM task GROUP BY 1""")
def a12_a13_pipeline_health(spark, sf):
    t = tasks(spark, sf)
    wide = t.groupBy("queue").pivot("status", ["pending", "processing", "failed", "completed"]).agg(F.count("id")).na.fill(0)
    return wide.join(t.groupBy("queue").agg(F.max("created_at").alias("newest")), "queue")


@P.query(f"{with_sql(TASK_SQL)} SELECT id, created_at, attempts FROM task WHERE source_id = 7 AND status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 5")
def a26_recent_failures(spark, sf):
    return tasks(spark, sf).filter("source_id = 7 and status = 'failed'").select("id", "created_at", "attempts").orderBy(F.desc("created_at"), F.desc("id")).limit(5)


@P.query(f"""{with_sql(TASK_SQL)}, l AS (SELECT source_id, id, locked_at, lag(locked_at) OVER (PARTITION BY source_id ORDER BY locked_at, id) AS before FROM task WHERE locked_at IS NOT NULL)
SELECT source_id, count(*) AS locks, count(*) FILTER (WHERE before IS NOT NULL AND epoch_us(locked_at) - epoch_us(before) < 72 * 1000000) AS too_soon FROM l GROUP BY 1""")
def w8_lock_spacing(spark, sf):
    w = Window.partitionBy("source_id").orderBy("locked_at", "id")
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    locks = tasks(spark, sf).filter("locked_at is not null").withColumn("before", F.lag("locked_at").over(w))
    soon = F.coalesce(micros("locked_at") - micros("before") < 72 * 1_000_000, F.lit(False))
    return locks.groupBy("source_id").agg(F.count("*").alias("locks"), F.count_if(soon).alias("too_soon"))


SCORE_BUCKETS = (40, 50, 60, 70, 80, 90, 95, 100)


@P.query("SELECT event_type, " + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{b}" for b in SCORE_BUCKETS) + ", count(*) AS total, round(sum(value), 4) AS total_value FROM events GROUP BY 1")
def m1_histogram(spark, sf):
    """Cumulative bucket counts, as a histogram metric keeps them."""
    return table(spark, sf, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in SCORE_BUCKETS], F.count("*").alias("total"), F.round(F.sum("value"), 4).alias("total_value"))


@P.query("""WITH b AS (SELECT unnest([1, 5, 10, 20, 40, 60, 80, 100]) AS le), c AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n, count(*) FILTER (WHERE value <= 100) AS total FROM events, b GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before FROM c WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, q, round(low + (le - low) * (q * total - before) / (n - before), 6) AS value FROM l, (SELECT unnest([0.5, 0.95]) AS q) WHERE n >= q * total AND before < q * total""")
def m2_histogram_quantile(spark, sf):
    """Quantiles by linear interpolation inside the bucket that holds them."""
    les = [1, 5, 10, 20, 40, 60, 80, 100]
    wide = table(spark, sf, "events").groupBy("event_type").agg(F.array(*[F.struct(F.lit(b).alias("le"), F.lit(a).alias("low"), F.count_if(F.col("value") <= b).alias("n"), F.count_if(F.col("value") <= a).alias("before")) for a, b in zip([0, *les], les, strict=False)]).alias("b"), F.count_if(F.col("value") <= 100).alias("total"))
    first = wide.withColumn("b", F.transform("b", lambda x: F.when(x["low"] == 0, F.struct(x["le"], x["low"], x["n"], F.lit(0).cast("long").alias("before"))).otherwise(x)))
    rows = first.select("event_type", "total", F.explode("b").alias("b"), F.lit(None)).select("event_type", "total", "b.*").withColumn("q", F.explode(F.array(F.lit(0.5), F.lit(0.95))))
    goal = F.col("q") * F.col("total")
    hit = rows.filter((F.col("n") >= goal) & (F.col("before") < goal))
    return hit.select("event_type", "q", F.round(F.col("low") + (F.col("le") - F.col("low")) * (goal - F.col("before")) / (F.col("n") - F.col("before")), 6).alias("value"))


@P.query("SELECT date_trunc('day', ts) AS day, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_ratio, count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.15 AS alert FROM events GROUP BY 1")
def m3_ratio_alert(spark, sf):
    ratio = F.count_if(F.col("event_type") == "error") / F.count("*")
    return table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.round(ratio, 6).alias("error_ratio"), (ratio > 0.15).alias("alert"))

"""Readers. The driver's tables stand in for the catalogue's entities: part for products, lineitem for offers and source
records, supplier for sellers and sources, events for tasks and search events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def specs_json() -> F.Column:
    """The product's attributes as one JSON document, as the catalogue keeps them."""
    colour, kind = F.split("p_name", " ")[0], F.element_at(F.split("p_name", " "), -1)
    return F.to_json(F.struct(
        F.col("p_size").alias("size"), F.format_string("%d mm", F.col("p_size")).alias("width"), colour.alias("colour"),
        (F.col("p_size") % 2 == 0).alias("wireless"), F.array(colour, kind).alias("tags"),
        F.when(F.col("p_size") > 5, F.lit("n/a")).otherwise(F.col("p_size").cast("string")).alias("ports"),
    ))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, display_name, brand, category, size, price, release_year, enabled, specs (JSON)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("display_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").alias("size"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        (F.lit(2010) + F.col("p_size") % 15).cast("int").alias("release_year"), (F.col("p_partkey") % 7 != 0).alias("enabled"), specs_json().alias("specs"),
    )


PRODUCT_SQL = """product AS (
  SELECT p_partkey AS id, p_name AS display_name, p_brand AS brand, p_type AS category, p_size AS size, p_retailprice::DECIMAL(12,2) AS price,
    (2010 + p_size % 15)::INTEGER AS release_year, p_partkey % 7 <> 0 AS enabled, string_split(p_name, ' ')[1] AS colour,
    p_size % 2 = 0 AS wireless, string_split(p_name, ' ')[-1] AS kind, CASE WHEN p_size > 5 THEN 'n/a' ELSE p_size::VARCHAR END AS ports
  FROM part)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, model_id, seller_id, order_id, line, price, currency, active, observed_at, condition of every offer."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("listing"), F.col("l_partkey").alias("model_id"), F.col("l_suppkey").alias("seller_id"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("decimal(14,0)") / F.lit(100)).cast("decimal(12,2)").alias("price"), (F.col("l_linestatus") == "O").alias("active"),
        F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_returnflag") == "R", "refurbished").when(F.col("l_returnflag") == "A", "used").otherwise("new").alias("condition"),
    )


OFFER_SQL = """offer AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing, l_partkey AS model_id, l_suppkey AS seller_id,
    (floor(l_extendedprice / l_quantity * 100 + 0.5)::DECIMAL(14,0) / 100)::DECIMAL(12,2) AS price, l_linestatus = 'O' AS active, l_shipdate AS observed_at,
    CASE l_returnflag WHEN 'R' THEN 'refurbished' WHEN 'A' THEN 'used' ELSE 'new' END AS condition
  FROM lineitem)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work-queue rows from events: id, source_id, seller_id, queue, status, attempts, locked_at, created_at, scheduled_at."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "processing").when(F.col("event_type") == "signup", "completed").otherwise("pending")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("source_id"), (F.col("user_id") % 9).alias("seller_id"),
        F.when(F.col("user_id") % 3 == 0, "list").when(F.col("user_id") % 3 == 1, "detail").otherwise("discovery").alias("queue"), status.alias("status"),
        (F.col("event_id") % 5).cast("int").alias("attempts"), F.when(status.isin("processing", "failed", "completed"), F.col("ts")).alias("locked_at"),
        F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("interval 30 days")).alias("scheduled_at"),
    )


TASK_SQL = """task AS (
  SELECT *, CASE WHEN status IN ('processing', 'failed', 'completed') THEN created_at END AS locked_at FROM (
    SELECT event_id AS id, user_id % 40 AS source_id, user_id % 9 AS seller_id,
      CASE user_id % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'detail' ELSE 'discovery' END AS queue,
      CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'processing' WHEN 'signup' THEN 'completed' ELSE 'pending' END AS status,
      (event_id % 5)::INTEGER AS attempts, ts AS created_at, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 30 DAY END AS scheduled_at
    FROM events))"""


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a product from several sources: model_id, source_id, price, quantity, tax, flag, last_updated, url."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("model_id"), F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("last_updated"),
        F.format_string("https://www.shop%d.example.com/p/%d/", F.col("l_suppkey"), F.col("l_partkey")).alias("url"),
    )


RECORD_SQL = """record AS (
  SELECT l_partkey AS model_id, l_suppkey AS source_id, l_orderkey AS record_id, l_linenumber AS line, l_quantity AS quantity, l_tax AS tax,
    l_returnflag AS flag, l_shipdate AS last_updated, 'https://www.shop' || l_suppkey || '.example.com/p/' || l_partkey || '/' AS url
  FROM lineitem)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and sellers from supplier: id, name, priority, max_concurrent, requests_per_hour, enabled, url."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5).cast("int").alias("priority"),
        F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 60).cast("int")).alias("max_concurrent"),
        F.when(F.col("s_suppkey") % 6 != 0, (F.col("s_suppkey") % 7 + 1).cast("int")).alias("requests_per_hour"), (F.col("s_suppkey") % 10 != 3).alias("enabled"),
        F.format_string("https://www.shop%d.example.com/", F.col("s_suppkey")).alias("url"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"),
    )


SOURCE_SQL = """source AS (
  SELECT s_suppkey AS id, s_name AS name, (s_suppkey % 5)::INTEGER AS priority, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 60)::INTEGER END AS max_concurrent,
    CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey % 7 + 1)::INTEGER END AS requests_per_hour, s_suppkey % 10 <> 3 AS enabled,
    'https://www.shop' || s_suppkey || '.example.com/' AS url, s_nationkey AS nation_id, s_acctbal AS balance
  FROM supplier)"""

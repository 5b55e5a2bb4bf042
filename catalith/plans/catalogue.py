"""Scans, predicates, joins, windows and orders over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.plans.define import Plans
from catalith.sources.tables import OFFER_SQL, PRODUCT_SQL, RECORD_SQL, SOURCE_SQL, offers, products, source_records, sources, table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def member(column: str, values: list) -> Column:
    """`column in values`; no filter for an empty list."""
    return F.col(column).isin(values) if values else F.lit(True)


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held with the rows of new, which win by key; a keyed merge by union and one window."""
    both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    return both.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_new", "_place")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, display_name, price FROM product WHERE category = 'ECONOMY' AND size > 25 ORDER BY price DESC, id")
def s1_scan_where_order(spark, sf):
    return products(spark, sf).filter("category = 'ECONOMY' and size > 25").select("id", "display_name", "price").orderBy(F.desc("price"), "id")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, display_name, brand FROM product WHERE id = 17")
def s2_point_lookup(spark, sf):
    return products(spark, sf).filter("id = 17").select("id", "display_name", "brand")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, display_name FROM product WHERE id IN (3, 5, 8, 13, 99999999)")
def s3_multi_get(spark, sf):
    return products(spark, sf).filter(F.col("id").isin(3, 5, 8, 13, 99999999)).select("id", "display_name")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, display_name FROM product WHERE brand = 'Brand#7' ORDER BY id LIMIT 1")
def s4_find_one(spark, sf):
    return products(spark, sf).filter("brand = 'Brand#7'").select("id", "display_name").orderBy("id").limit(1)


@P.query(f"""{with_sql(PRODUCT_SQL)}, f AS (SELECT id, price FROM product WHERE enabled AND size < 10)
SELECT id, price, (SELECT count(*) FROM f) AS total, (SELECT ceil(count(*) / 40.0)::BIGINT FROM f) AS total_pages FROM f ORDER BY price, id LIMIT 40 OFFSET 40""")
def s5_page_and_count(spark, sf):
    found = products(spark, sf).filter("enabled and size < 10").select("id", "price")
    total = found.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 40).alias("total_pages"))
    return found.orderBy("price", "id").offset(40).limit(40).join(F.broadcast(total), F.lit(True))


@P.query(f"""{with_sql(PRODUCT_SQL)}
SELECT id, CASE WHEN id % 10 = 0 THEN price + 1 ELSE price END::DECIMAL(12,2) AS price, CASE WHEN id % 10 = 0 THEN 'new' ELSE 'held' END AS version FROM product WHERE id % 3 <> 1 OR id % 10 = 0""")
def s6_upsert_and_delete(spark, sf):
    rows = products(spark, sf).select("id", "price")
    held = rows.withColumn("version", F.lit("held")).filter("id % 3 <> 1")
    new = rows.filter("id % 10 = 0").select("id", (F.col("price") + 1).cast("decimal(12,2)").alias("price"), F.lit("new").alias("version"))
    return upsert(held, new, ["id"])


@P.query(f"{with_sql(RECORD_SQL)} SELECT DISTINCT model_id, source_id, url FROM record WHERE source_id = 5 AND model_id % 4 = 1")
def s7_record_lookup(spark, sf):
    return source_records(spark, sf).filter("source_id = 5 and model_id % 4 = 1").select("model_id", "source_id", "url").distinct()


@P.query(f"""{with_sql(RECORD_SQL)} SELECT DISTINCT url FROM record WHERE rtrim(lower(url), '/') IN (
  SELECT 'https://www.shop' || s_suppkey || '.example.com/p/' || p_partkey FROM supplier, part WHERE s_suppkey < 5 AND p_partkey < 50)""")
def s8_existing_urls(spark, sf):
    from catalith.functions.text import url_key

    asked = spark.createDataFrame([(f"https://www.shop{s}.example.com/p/{p}",) for s in range(5) for p in range(50)], "key string")
    held = source_records(spark, sf).select("url").distinct().withColumn("key", url_key(F.col("url")))
    return held.join(asked, "key", "left_semi").select("url")


@P.query(f"""{with_sql(PRODUCT_SQL, RECORD_SQL, SOURCE_SQL)}
SELECT r.record_id, r.line, p.id, p.display_name, s.name AS source_name, n_name AS nation FROM record r JOIN product p ON p.id = r.model_id
JOIN source s ON s.id = r.source_id LEFT JOIN nation ON n_nationkey = s.nation_id WHERE p.category = 'PROMO' AND p.size = 7""")
def s9_records_with_relations(spark, sf):
    p = products(spark, sf).filter("category = 'PROMO' and size = 7").select("id", "display_name")
    s = sources(spark, sf).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "nation_id")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"))
    r = source_records(spark, sf).select("record_id", "line", "model_id", "source_id")
    return r.join(p, r["model_id"] == p["id"]).join(s, "source_id").join(n, "nation_id", "left").select("record_id", "line", "id", "display_name", "source_name", "nation")


@P.query("SELECT 'INSERT INTO nation VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''');' AS statement FROM nation")
def s15_insert_statements(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.format_string("INSERT INTO nation VALUES (%d, '%s');", "n_nationkey", F.replace("n_name", F.lit("'"), F.lit("''"))).alias("statement"))


TREE = """WITH RECURSIVE node AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
tree AS (
  SELECT id, name, 0 AS depth, name AS path FROM node WHERE parent IS NULL
  UNION ALL
  SELECT n.id, n.name, t.depth + 1, t.path || ' > ' || n.name FROM node n JOIN tree t ON n.parent = t.id)
SELECT id, name, depth, path FROM tree"""


@P.query(TREE)
def s16_category_tree(spark, sf):
    for name in ("region", "nation"):
        table(spark, sf, name).createOrReplaceTempView(f"s16_{name}")
    return spark.sql(TREE.replace("FROM region", "FROM s16_region").replace("FROM nation", "FROM s16_nation").replace("NULL::VARCHAR", "CAST(NULL AS STRING)"))


@P.query("SELECT id, name, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS level FROM (SELECT r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_regionkey, n_name FROM nation)")
def s17_roots_first(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return r.union(n).select("id", "name", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level")).orderBy("level", "name")


@P.query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def s18_json_keys(spark, sf):
    return table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@P.query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE event_type = 'error'")
def s19_log_json(spark, sf):
    """Pulls the JSON at the end of log lines."""
    lines = table(spark, sf, "events").filter("event_type = 'error'").select("event_id", F.concat_ws(" ", F.lit("[worker] failed:"), "event_type", "props").alias("line"))
    tail = F.from_json(F.regexp_extract("line", r"(\{.*\})\s*$", 1), "k long")
    return lines.select("event_id", tail["k"].alias("k"))


@P.query(f"{with_sql(SOURCE_SQL)} SELECT id, name FROM source WHERE regexp_replace(regexp_extract(url, '://([^/]+)', 1), '^www\\.', '') IN ('shop3.example.com', 'shop42.example.com')")
def s20_source_by_domain(spark, sf):
    from catalith.functions.text import domain

    wanted = spark.createDataFrame([("shop3.example.com",), ("shop42.example.com",)], "domain string")
    return sources(spark, sf).withColumn("domain", domain(F.col("url"))).join(F.broadcast(wanted), "domain", "left_semi").select("id", "name")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, brand AS brand_name, lower(category) AS category_slug, category AS category_name FROM product")
def p1_p2_projection(spark, sf):
    nested = products(spark, sf).select("id", F.struct(F.col("brand").alias("name")).alias("brand"), F.struct(F.lower("category").alias("slug"), F.col("category").alias("name")).alias("category"))
    return nested.select("id", F.col("brand.name").alias("brand_name"), F.col("category.slug").alias("category_slug"), F.col("category.name").alias("category_name"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id FROM product WHERE brand IN ('Brand#1', 'Brand#2') AND category IN ('PROMO', 'SMALL')")
def p3_in_lists(spark, sf):
    return products(spark, sf).filter(member("brand", ["Brand#1", "Brand#2"]) & member("category", ["PROMO", "SMALL"]) & member("size", [])).select("id")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, display_name FROM product WHERE lower(display_name) LIKE '%ring%' OR brand ILIKE '%#12%'")
def p4_p5_contains(spark, sf):
    return products(spark, sf).filter(F.contains(F.lower("display_name"), F.lit("ring")) | F.col("brand").ilike("%#12%")).select("id", "display_name")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id FROM product WHERE colour = 'red' AND size BETWEEN 10 AND 20 AND wireless AND TRY_CAST(ports AS DOUBLE) IS NULL")
def p7_p10_json_predicates(spark, sf):
    v = F.parse_json("specs")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    rows = products(spark, sf)
    ok = (get("$.colour", "string") == "red") & get("$.size", "double").between(10, 20) & get("$.wireless", "boolean") & get("$.ports", "string").try_cast("double").isNull()
    return rows.filter(ok).select("id")


def value_filter(value: Column, text: str) -> Column:
    """`3,10-20,-2,40-`: exact values and inclusive ranges, either end open, OR-ed. Items that aren't ranges of numbers are exact values."""
    import re

    found = F.lit(False)
    for item in filter(None, (x.strip() for x in text.split(","))):
        ends = re.fullmatch(r"(\d+(?:\.\d+)?)?-(\d+(?:\.\d+)?)?", item)
        if ends and item != "-":
            low, high = ends.groups()
            number = value.try_cast("double")
            found |= (F.lit(True) if low is None else number >= float(low)) & (F.lit(True) if high is None else number <= float(high))
        else:
            found |= value == item
    return F.coalesce(found, F.lit(False))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, size FROM product WHERE size = 3 OR size BETWEEN 10 AND 20 OR size <= 2 OR size >= 45")
def p11_p12_multi_values(spark, sf):
    return products(spark, sf).filter(value_filter(F.get_json_object("specs", "$.size"), "3,10-20,-2,45-")).select("id", "size")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id FROM product WHERE colour = 'blue' OR kind = 'blue'")
def p13_array_membership(spark, sf):
    tags = F.from_json(F.get_json_object("specs", "$.tags"), "array<string>")
    return products(spark, sf).filter(F.array_contains(tags, "blue")).select("id")


@P.query(f"{with_sql(PRODUCT_SQL, OFFER_SQL)} SELECT id FROM product p WHERE size < 20 AND EXISTS (SELECT 1 FROM offer o WHERE o.model_id = p.id AND o.active AND o.condition = 'used')")
def p14_offer_predicate(spark, sf):
    used = offers(spark, sf).filter("active and condition = 'used'").select(F.col("model_id").alias("id"))
    return products(spark, sf).filter("size < 20").select("id").join(used, "id", "left_semi")


@P.query(f"{with_sql(RECORD_SQL)} SELECT count(*) AS n FROM record WHERE regexp_replace(lower(url), '/+$', '') = 'https://www.shop7.example.com/p/7'")
def p17_url_equality(spark, sf):
    from catalith.functions.text import url_key

    return source_records(spark, sf).filter(url_key(F.col("url")) == url_key(F.lit("https://www.Shop7.example.com/p/7//"))).agg(F.count("*").alias("n"))


@P.query(f"""{with_sql(PRODUCT_SQL)} SELECT a.id AS a, b.id AS b FROM product a JOIN product b ON a.brand = b.brand AND a.size = b.size AND a.id < b.id
WHERE a.category = 'PROMO' OR b.category = 'PROMO'""")
def p18_either_side(spark, sf):
    a = products(spark, sf).select(F.col("id").alias("a"), "brand", "size", F.col("category").alias("ca"))
    b = products(spark, sf).select(F.col("id").alias("b"), "brand", "size", F.col("category").alias("cb"))
    return a.join(b, ["brand", "size"]).filter("a < b and (ca = 'PROMO' or cb = 'PROMO')").select("a", "b")


@P.query("SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 5 DAY END IS NULL OR ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-20'")
def p19_not_expired(spark, sf):
    e = table(spark, sf, "events").withColumn("expires", F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("interval 5 days")))
    return e.filter("expires is null or expires > timestamp_ntz'2024-01-20'").select("event_id")


@P.query(f"""{with_sql(PRODUCT_SQL, OFFER_SQL)}
SELECT p.id, p.brand, o.n_offers, o.low FROM product p LEFT JOIN (SELECT model_id, count(*) AS n_offers, min(price) AS low FROM offer WHERE active GROUP BY 1) o ON o.model_id = p.id""")
def j1_j4_product_offers(spark, sf):
    o = offers(spark, sf).filter("active").groupBy(F.col("model_id").alias("id")).agg(F.count("*").alias("n_offers"), F.min("price").alias("low"))
    return products(spark, sf).select("id", "brand").join(o, "id", "left")


@P.query(f"""{with_sql(RECORD_SQL)} SELECT model_id, list_sort(list_distinct(list(source_id))) AS sources FROM record GROUP BY 1""")
def j2_nested_children(spark, sf):
    return source_records(spark, sf).groupBy("model_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id FROM product WHERE brand IN (SELECT brand FROM product WHERE size = 50 AND enabled)")
def j7_j8_semi_join(spark, sf):
    p = products(spark, sf)
    return p.select("id", "brand").join(p.filter("size = 50 and enabled").select("brand"), "brand", "left_semi").select("id")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, TRY_CAST(ports AS DOUBLE) AS ports FROM product WHERE TRY_CAST(ports AS DOUBLE) >= 2")
def j11_lateral_number(spark, sf):
    return products(spark, sf).select("id", F.get_json_object("specs", "$.ports").try_cast("double").alias("ports")).filter("ports >= 2")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, unnest([colour, kind]) AS tag FROM product")
def j12_lateral_unnest(spark, sf):
    return products(spark, sf).select("id", F.explode(F.from_json(F.get_json_object("specs", "$.tags"), "array<string>")).alias("tag"))


@P.query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id < 5)
SELECT query_id, vec_id, place FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id)::INTEGER AS place,
  list_cosine_similarity(q.e, v.e) AS c FROM q JOIN v ON q.vec_id <> v.vec_id) WHERE place <= 5 AND c > 0.0""")
def j13_vector_join(spark, sf):
    from catalith.functions.similarity import cosine

    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))  # five query vectors
    scored = v.join(F.broadcast(q), F.expr("vec_id <> query_id")).select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 9).alias("score")).filter("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("place", F.row_number().over(best)).filter("place <= 5").select("query_id", "vec_id", "place")


@P.query(f"""{with_sql(RECORD_SQL)}, found AS (SELECT DISTINCT rtrim(url, '/') AS url FROM record WHERE source_id % 4 = 0)
SELECT url FROM found WHERE url NOT IN (SELECT rtrim(url, '/') FROM record WHERE record_id % 5 = 0) AND url NOT IN (SELECT rtrim(url, '/') FROM record WHERE flag = 'R' AND source_id < 20)""")
def j16_new_urls(spark, sf):
    from catalith.functions.text import url_key

    r = source_records(spark, sf).withColumn("url", url_key(F.col("url")))
    known, queued = r.filter("record_id % 5 = 0").select("url"), r.filter("flag = 'R' and source_id < 20").select("url")
    return r.filter("source_id % 4 = 0").select("url").distinct().join(known, "url", "left_anti").join(queued, "url", "left_anti")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id FROM product WHERE display_name LIKE 'red%' OR display_name LIKE 'small%'")
def j18_prefix_list(spark, sf):
    names = spark.createDataFrame([("Red",), ("small",)], "prefix string")
    return products(spark, sf).join(F.broadcast(names), F.expr("startswith(lower(display_name), lower(prefix))"), "left_semi").select("id")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT count(*) AS n, count(*) FILTER (WHERE wireless) AS true_count, count(wireless) AS known, min(size)::DOUBLE AS low, max(size)::DOUBLE AS high FROM product WHERE enabled")
def a1_a3_counts_and_ranges(spark, sf):
    wireless, size = F.get_json_object("specs", "$.wireless").try_cast("boolean"), F.get_json_object("specs", "$.size").try_cast("double")
    return products(spark, sf).filter("enabled").agg(F.count("*").alias("n"), F.count_if(wireless).alias("true_count"), F.count(wireless).alias("known"), F.min(size).alias("low"), F.max(size).alias("high"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT colour AS value, count(*) AS n FROM product WHERE colour IS NOT NULL AND colour <> '' GROUP BY 1")
def a4_value_facet(spark, sf):
    return products(spark, sf).groupBy(F.get_json_object("specs", "$.colour").alias("value")).agg(F.count("*").alias("n")).filter("value <> ''")


BUCKETS = [("small", 1, 10), ("medium", 10, 30), ("large", 31, 44), ("none", 500, 600)]


@P.query(f"""{with_sql(PRODUCT_SQL)}, b AS (SELECT * FROM (VALUES ('small', 0), ('medium', 1), ('large', 2), ('none', 3)) t(bucket, place)),
c AS (SELECT CASE WHEN size BETWEEN 1 AND 10 THEN 'small' WHEN size BETWEEN 10 AND 30 THEN 'medium' WHEN size BETWEEN 31 AND 44 THEN 'large' END AS bucket, count(*) AS n FROM product GROUP BY 1)
SELECT b.bucket, place, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bucket = c.bucket""")
def a5_bucket_facet(spark, sf):
    """Inclusive bounds, the first bucket that fits; what fits none is dropped, empty buckets stay."""
    case = F.coalesce(*[F.when(F.col("size").between(low, high), name) for name, low, high in BUCKETS])
    counted = products(spark, sf).groupBy(case.alias("bucket")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(name, i) for i, (name, *_) in enumerate(BUCKETS)], "bucket string, place int")
    return names.join(counted, "bucket", "left").select("bucket", "place", F.coalesce("n", F.lit(0)).alias("n"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT tag, count(DISTINCT id) AS n FROM (SELECT id, unnest([colour, kind]) AS tag FROM product) GROUP BY 1")
def a6_array_facet(spark, sf):
    return products(spark, sf).select("id", F.explode(F.from_json(F.get_json_object("specs", "$.tags"), "array<string>")).alias("tag")).groupBy("tag").agg(F.count_distinct("id").alias("n"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT lower(replace(brand, '#', '-')) AS slug, brand AS name, count(*) AS n FROM product GROUP BY 2 ORDER BY n DESC, name")
def a7_brand_facet(spark, sf):
    from catalith.functions.text import slug

    return products(spark, sf).groupBy("brand").agg(F.count("*").alias("n")).select(slug(F.col("brand")).alias("slug"), F.col("brand").alias("name"), "n").orderBy(F.desc("n"), "name")


@P.query(f"{with_sql(OFFER_SQL)} SELECT model_id, price, seller_id FROM offer WHERE active QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY price, seller_id, listing) = 1")
def a14_cheapest_offer(spark, sf):
    best = F.min(F.struct("price", "seller_id", "listing"))
    return offers(spark, sf).filter("active").groupBy("model_id").agg(best.alias("o")).select("model_id", "o.price", "o.seller_id")


@P.query(f"{with_sql(RECORD_SQL)} SELECT model_id, source_id, record_id, line, last_updated FROM record QUALIFY row_number() OVER (PARTITION BY model_id, source_id ORDER BY last_updated DESC, record_id DESC, line DESC, quantity DESC, tax DESC) = 1")
def a15_w1_latest_record(spark, sf):
    latest = F.max(F.struct("last_updated", "record_id", "line", "quantity", "tax")).alias("r")
    return source_records(spark, sf).groupBy("model_id", "source_id").agg(latest).select("model_id", "source_id", "r.record_id", "r.line", "r.last_updated")


@P.query(f"""{with_sql(RECORD_SQL, SOURCE_SQL)}, c AS (SELECT model_id, flag, count(*) AS votes, max(last_updated) AS newest FROM record GROUP BY 1, 2)
SELECT model_id, flag, votes FROM c QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY votes DESC, newest DESC, flag) = 1""")
def a16_corroboration_vote(spark, sf):
    votes = source_records(spark, sf).groupBy("model_id", "flag").agg(F.count("*").alias("votes"), F.max("last_updated").alias("newest"))
    best = Window.partitionBy("model_id").orderBy(F.desc("votes"), F.desc("newest"), "flag")
    return votes.withColumn("place", F.row_number().over(best)).filter("place = 1").select("model_id", "flag", "votes")


@P.query(f"{with_sql(RECORD_SQL)} SELECT model_id, list_sort(list_distinct(list(flag))) AS aliases FROM record WHERE flag <> 'N' GROUP BY 1")
def a18_alias_union(spark, sf):
    r = source_records(spark, sf).groupBy("model_id").agg(F.array_sort(F.array_except(F.collect_set("flag"), F.array(F.lit("N")))).alias("aliases"))
    return r.filter(F.size("aliases") > 0)


@P.query(f"{with_sql(OFFER_SQL)} SELECT model_id, arg_min(seller_id, (observed_at, listing)) AS first_seller, max(observed_at) AS last_seen FROM offer GROUP BY 1")
def a19_a20_first_and_last(spark, sf):
    return offers(spark, sf).groupBy("model_id").agg(F.min_by("seller_id", F.struct("observed_at", "listing")).alias("first_seller"), F.max("observed_at").alias("last_seen"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT category, count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled FROM product GROUP BY 1")
def a27_category_counts(spark, sf):
    return products(spark, sf).groupBy("category").agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT category, brand, count(*) AS n, grouping(category) + grouping(brand) AS level FROM product GROUP BY ROLLUP (category, brand)")
def a28_rollup_extension(spark, sf):
    """Extension: subtotals by category and brand."""
    return products(spark, sf).rollup("category", "brand").agg(F.count("*").alias("n"), (F.grouping("category").cast("int") + F.grouping("brand").cast("int")).cast("long").alias("level"))


@P.query(f"""{with_sql(OFFER_SQL)}, s AS (SELECT model_id, seller_id, min(price) AS price FROM offer WHERE active GROUP BY 1, 2)
SELECT model_id, seller_id, price, lead_price - price AS gap FROM (SELECT *, lead(price) OVER w AS lead_price, row_number() OVER w AS place FROM s WINDOW w AS (PARTITION BY model_id ORDER BY price, seller_id)) WHERE place = 1""")
def w2_best_and_gap(spark, sf):
    by = offers(spark, sf).filter("active").groupBy("model_id", "seller_id").agg(F.min("price").alias("price"))
    w = Window.partitionBy("model_id").orderBy("price", "seller_id")
    return by.withColumn("next", F.lead("price").over(w)).withColumn("place", F.row_number().over(w)).filter("place = 1").select("model_id", "seller_id", "price", (F.col("next") - F.col("price")).cast("decimal(12,2)").alias("gap"))


@P.query(f"{with_sql(OFFER_SQL)} SELECT model_id, listing FROM offer WHERE active QUALIFY price <= min(price) OVER (PARTITION BY model_id) + 50")
def w3_floor(spark, sf):
    floor = F.min("price").over(Window.partitionBy("model_id"))
    return offers(spark, sf).filter("active").withColumn("floor", floor).filter("price <= floor + 50").select("model_id", "listing")


@P.query(f"{with_sql(OFFER_SQL)} SELECT model_id, listing, (row_number() OVER (PARTITION BY model_id ORDER BY observed_at, listing) - 1)::INTEGER AS position FROM offer")
def w4_w5_positions(spark, sf):
    return offers(spark, sf).select("model_id", "listing", (F.row_number().over(Window.partitionBy("model_id").orderBy("observed_at", "listing")) - 1).alias("position"))


@P.query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events")
def w7_carry_forward(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@P.query(f"{with_sql(SOURCE_SQL)} SELECT id, name, max_concurrent FROM source ORDER BY max_concurrent DESC NULLS LAST, id LIMIT 30")
def o1_o2_nulls_last(spark, sf):
    return sources(spark, sf).select("id", "name", "max_concurrent").orderBy(F.col("max_concurrent").desc_nulls_last(), "id").limit(30)


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, display_name FROM product WHERE enabled ORDER BY release_year DESC, id DESC LIMIT 30")
def o6_newest(spark, sf):
    return products(spark, sf).filter("enabled").orderBy(F.desc("release_year"), F.desc("id")).select("id", "display_name").limit(30)


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, price FROM (SELECT DISTINCT ON (display_name) id, price, display_name FROM product ORDER BY display_name, price, id) ORDER BY price, id LIMIT 4")
def o5_o10_unique_then_take(spark, sf):
    first = Window.partitionBy("display_name").orderBy("price", "id")
    return products(spark, sf).withColumn("place", F.row_number().over(first)).filter("place = 1").select("id", "price").orderBy("price", "id").limit(4)


@P.query(f"""{with_sql(PRODUCT_SQL)} SELECT id, list_sort(list_filter(['red', 'blue', 'ring', 'widget'], lambda x: x NOT IN (colour, kind))) AS missing, colour IN ('red', 'blue') AND kind IN ('ring') AS inside FROM product""")
def o12_o13_array_sets(spark, sf):
    tags = F.from_json(F.get_json_object("specs", "$.tags"), "array<string>")
    every = lambda *x: F.array(*map(F.lit, x))
    inside = F.array_contains(every("red", "blue"), F.get(tags, F.lit(0))) & (F.get(tags, F.lit(1)) == "ring")
    return products(spark, sf).select("id", F.array_sort(F.array_except(every("red", "blue", "ring", "widget"), tags)).alias("missing"), inside.alias("inside"))

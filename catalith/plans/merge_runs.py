"""A run of merges over products with similar names, and what it leaves of the tables that hang on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalith.operators.duplicates import alike_names
from catalith.operators.merge_run import first_merges, forest, new_aliases, reordered, repointed, touched
from catalith.operators.merging import identity
from catalith.plans.define import Plans
from catalith.plans.search import similarity_sql
from catalith.sources.shared import written
from catalith.sources.tables import OFFER_SQL, PRODUCT_SQL, RECORD_SQL, TASK_SQL, offers, products, source_records, tasks

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

#: Merges of one run, and the name similarity from which a pair is merged.
CAP, LEAST = 50, 0.6


def dated(spark, sf):
    """Products with a model name and the day they came in."""
    kind = F.element_at(F.split("display_name", " "), -1)
    return products(spark, sf).withColumns({"model": F.concat_ws(" ", kind, "size"), "created": (F.col("id") * 37 % 1000).cast("int")})


def run(spark, sf):
    """The merges of one run: pairs of one brand and category by name similarity, the older product stays."""
    p, keys = dated(spark, sf), ["brand", "category"]
    names = alike_names(p, keys, LEAST).select(*keys, "name_a", "name_b", F.round("trigram", 6).alias("score"))
    return written(first_merges(p.withColumnRenamed("display_name", "name"), written(names, "names"), keys, CAP), "run")


RUN_SQL = f"""WITH RECURSIVE {PRODUCT_SQL},
p AS (SELECT *, kind || ' ' || size AS model, id * 37 % 1000 AS created FROM product),
pair AS (SELECT a.id AS a, b.id AS b, a.created <= b.created AS keep_a, round(CASE WHEN a.display_name = b.display_name THEN 1 ELSE {similarity_sql("a.display_name", "b.display_name")} END, 6) AS score
  FROM p a JOIN p b ON a.brand = b.brand AND a.category = b.category AND a.id < b.id),
m AS MATERIALIZED (SELECT CASE WHEN keep_a THEN b ELSE a END AS source, CASE WHEN keep_a THEN a ELSE b END AS target, row_number() OVER (ORDER BY score DESC, a, b) AS n FROM pair WHERE score >= 0.6),
walk(n, gone, made) AS (
  SELECT 0::BIGINT, []::BIGINT[], false
  UNION ALL
  SELECT n, CASE WHEN ok THEN list_append(gone, source) ELSE gone END, ok FROM (
    SELECT m.n, gone, source, NOT list_contains(gone, source) AND NOT list_contains(gone, target) AND len(gone) < 50 AS ok FROM walk JOIN m ON m.n = walk.n + 1)),
made AS MATERIALIZED (SELECT source, target, row_number() OVER (ORDER BY n) AS place FROM walk JOIN m USING (n) WHERE made),
climb(product, root, path) AS (
  SELECT source, target, [place] FROM made
  UNION ALL
  SELECT product, target, list_prepend(place, path) FROM climb JOIN made ON source = root),
tree AS MATERIALIZED (SELECT product, arg_max(root, len(path)) AS root, arg_max(path, len(path)) AS path FROM climb GROUP BY product),
every AS MATERIALIZED (SELECT product, root, path, true AS moved FROM tree UNION ALL SELECT DISTINCT root, root, []::BIGINT[], false FROM tree)"""


@P.query(f"{RUN_SQL} SELECT source, target, place, root FROM made JOIN tree ON product = source")
def w6_merge_run(spark, sf):
    """The merges of a run in their order, with the product that is left in the end."""
    merges = run(spark, sf)
    roots = forest(merges).select(F.col("product").alias("source"), "root")
    return merges.withColumn("place", F.row_number().over(Window.orderBy("order")).cast("long")).join(roots, "source").select("source", "target", "place", "root")  # CAP rows


def records(spark, sf):
    """Records with an id and the source they are from; some are entered by hand and have none."""
    r = source_records(spark, sf).withColumn("id", F.col("record_id") * 8 + F.col("line"))
    return r.select("id", "model_id", F.when(F.col("record_id") % 11 != 0, F.col("source_id") % 20).alias("source_id"))


RECORDS_SQL = "r AS (SELECT record_id * 8 + line AS id, model_id, CASE WHEN record_id % 11 <> 0 THEN (source_id % 20)::VARCHAR ELSE 'manual' END AS source FROM record)"


@P.query(f"""{RUN_SQL}, {RECORD_SQL}, {RECORDS_SQL},
t AS (SELECT r.id, r.model_id, e.root, e.moved, e.path, min(e.path) OVER (PARTITION BY e.root, r.source) AS first FROM r JOIN every e ON e.product = r.model_id)
SELECT id, model_id, root, CASE WHEN path > first THEN 'delete' WHEN moved THEN 'move' ELSE 'keep' END AS action FROM t""")
def g6_records_after_run(spark, sf):
    """What becomes of the records of merged products: a source's stay with the product that had it first; those without a source count as of one."""
    trees = forest(run(spark, sf))
    return repointed(records(spark, sf), "model_id", [F.coalesce(F.col("source_id").cast("string"), F.lit("manual"))], trees).select("id", "model_id", "root", "action")


def listed_offers(spark, sf):
    """Offers with the listing of their seller, which several products may share; some have none."""
    number = F.split("listing", "-")
    return offers(spark, sf).withColumn("number", F.when(number[0].cast("long") % 9 != 0, number[0].cast("long") % 200))


OFFERS_SQL = "o AS (SELECT *, CASE WHEN string_split(listing, '-')[1]::BIGINT % 9 <> 0 THEN string_split(listing, '-')[1]::BIGINT % 200 END AS number FROM offer)"
OFFERS_AFTER_SQL = """t AS (SELECT o.listing, o.price, o.active, o.model_id, e.root, e.moved, e.path, CASE WHEN number IS NOT NULL THEN min(e.path) OVER (PARTITION BY e.root, seller_id, number) END AS first FROM o JOIN every e ON e.product = o.model_id),
a AS (SELECT *, CASE WHEN path > first THEN 'delete' WHEN moved THEN 'move' ELSE 'keep' END AS action FROM t)"""


def offers_after(spark, sf):
    return repointed(listed_offers(spark, sf), "model_id", [F.col("seller_id"), F.col("number")], forest(run(spark, sf)))


@P.query(f"{RUN_SQL}, {OFFER_SQL}, {OFFERS_SQL}, {OFFERS_AFTER_SQL} SELECT listing, model_id, root, action FROM a")
def g7_offers_after_run(spark, sf):
    """What becomes of the offers of merged products: a seller's listing stays with the product that had it first; offers without a listing always move."""
    return offers_after(spark, sf).select("listing", "model_id", "root", "action")


@P.query(f"{RUN_SQL}, {OFFER_SQL}, {OFFERS_SQL}, {OFFERS_AFTER_SQL} SELECT root AS model_id, min(price) FILTER (WHERE active AND action <> 'delete') AS price FROM a GROUP BY root")
def g11_prices_after_run(spark, sf):
    """The cheapest active offer of the products that took others in."""
    return offers_after(spark, sf).groupBy(F.col("root").alias("model_id")).agg(F.min(F.when(F.col("active") & (F.col("action") != "delete"), F.col("price"))).alias("price"))


@P.query(f"""{RUN_SQL}, {RECORD_SQL}, i AS (SELECT record_id * 8 + line AS id, model_id, line AS position FROM record),
t AS (SELECT i.*, e.root, e.moved, e.path, max(CASE WHEN NOT moved THEN position END) OVER (PARTITION BY e.root) AS last FROM i JOIN every e ON e.product = i.model_id)
SELECT id, root, (CASE WHEN moved THEN coalesce(last + 1, 0) + row_number() OVER (PARTITION BY root, moved ORDER BY path, position, id) - 1 ELSE position END)::INTEGER AS position FROM t""")
def g8_images_after_run(spark, sf):
    """Images of merged products behind those of the product they went into."""
    images = source_records(spark, sf).select((F.col("record_id") * 8 + F.col("line")).alias("id"), "model_id", F.col("line").alias("position"))
    return reordered(images, "model_id", "position", "id", forest(run(spark, sf))).select("id", "root", F.col("new_position").cast("int").alias("position"))


@P.query(f"""{RUN_SQL}, held AS (SELECT alias, min(id) AS product FROM (SELECT id, kind || ' ' || colour AS alias FROM product) GROUP BY alias),
n AS (SELECT made.place, made.target, s.display_name AS sn, lower(s.display_name) AS sp, s.model AS sm, t.display_name AS tn, lower(t.display_name) AS tp, lower(s.model) AS s, lower(t.model) AS t
  FROM made JOIN p s ON s.id = made.source JOIN p t ON t.id = made.target),
c AS (SELECT place, target, unnest([sn, sp, sm]) AS alias, tn, tp FROM n),
g AS (SELECT place, target, alias FROM c WHERE alias <> tn AND alias <> tp
  UNION ALL SELECT place, target, s FROM n WHERE s <> t AND len(list_intersect(regexp_extract_all(s, '\\d+'), regexp_extract_all(t, '\\d+'))) > 0),
f AS (SELECT alias, arg_min(target, place) AS product FROM g WHERE alias NOT IN (SELECT alias FROM held) GROUP BY alias),
u AS (SELECT alias, product, false AS created FROM held UNION ALL SELECT alias, product, true FROM f)
SELECT alias, root AS product, created FROM u JOIN every USING (product)""")
def g9_g12_aliases_after_run(spark, sf):
    """Aliases of the products that took others in: their own, moved ones, and the names of the merged."""
    p = dated(spark, sf)
    words = F.split("display_name", " ")
    held = p.groupBy(F.concat_ws(" ", F.element_at(words, -1), words[0]).alias("alias")).agg(F.min("id").alias("product"))
    merges = run(spark, sf)
    return new_aliases(merges, forest(merges), p, held)


@P.query(f"{RUN_SQL}, {TASK_SQL}, k AS (SELECT task.id, p_partkey AS product FROM task JOIN part ON p_partkey = task.id % (SELECT count(*) FROM part)) SELECT k.id, root AS product FROM k JOIN every USING (product) WHERE moved")
def g10_tasks_after_run(spark, sf):
    """Tasks of merged products, with the product they are for now."""
    p = products(spark, sf)
    every = p.agg(F.count("*").alias("_n"))
    t = tasks(spark, sf).join(F.broadcast(every), F.lit(True)).select("id", (F.col("id") % F.col("_n")).alias("product"))  # one row
    return touched(t, "product", forest(run(spark, sf))).filter("moved").select("id", F.col("root").alias("product"))


@P.query(f"{RUN_SQL} SELECT id, display_name FROM product WHERE id NOT IN (SELECT source FROM made)")
def g10_products_after_run(spark, sf):
    """The products that are left."""
    return products(spark, sf).join(run(spark, sf).select(F.col("source").alias("id")), "id", "left_anti").select("id", "display_name")


@P.query(f"""{RUN_SQL}, {RECORD_SQL}, r AS (SELECT record_id * 8 + line AS id, model_id, CASE WHEN record_id % 11 <> 0 THEN (source_id % 20)::VARCHAR ELSE 'manual' END AS source, source_id, flag, quantity, last_updated FROM record),
t AS (SELECT r.*, e.root, e.path, min(e.path) OVER (PARTITION BY e.root, r.source) AS first FROM r JOIN every e ON e.product = r.model_id),
l AS (SELECT *, source_id % 5 AS priority FROM t WHERE path = first QUALIFY row_number() OVER (PARTITION BY root, source ORDER BY last_updated DESC, id DESC, source_id DESC, flag DESC, quantity DESC) = 1),
c AS (SELECT root, last_updated, priority, -id AS t, unnest(['brand', 'model']) AS field, unnest(['B' || source_id % 3, flag || ' ' || quantity::INTEGER % 4]) AS value FROM l),
g AS (SELECT root, field, lower(value) AS same, count(*) AS votes, max((last_updated, priority, t)) AS newest, arg_max(value, (last_updated, priority, t)) AS value FROM c GROUP BY 1, 2, 3),
w AS (SELECT root, field, value FROM g QUALIFY row_number() OVER (PARTITION BY root, field ORDER BY votes DESC, newest DESC) = 1)
SELECT root AS model_id, max(value) FILTER (WHERE field = 'brand') AS brand, max(value) FILTER (WHERE field = 'model') AS model FROM w GROUP BY root""")
def g11_identity_after_run(spark, sf):
    """Identity of the products that took others in, agreed on anew by the latest record of each source that they have now."""
    r = source_records(spark, sf).withColumns({"id": F.col("record_id") * 8 + F.col("line"), "source": F.when(F.col("record_id") % 11 != 0, (F.col("source_id") % 20).cast("string")).otherwise("manual")})
    kept = repointed(r.drop("line"), "model_id", [F.col("source")], forest(run(spark, sf))).filter("action <> 'delete'")
    latest = kept.groupBy("root", "source").agg(F.max(F.struct("last_updated", "id", "source_id", "flag", "quantity")).alias("x")).select(F.col("root").alias("model_id"), "x.*")
    brand, model = F.concat(F.lit("B"), F.col("source_id") % 3), F.concat_ws(" ", "flag", F.col("quantity").cast("int") % 4)
    return identity(latest.select("model_id", "last_updated", (F.col("source_id") % 5).alias("priority"), F.col("id").alias("tie"), brand.alias("brand"), model.alias("model")), ["brand", "model"])

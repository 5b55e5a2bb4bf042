"""Filters and facets over specs that were written as typed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators.facets import Facet, count, passes
from catalith.operators.typed_specs import TypedSpecs
from catalith.plans.catalogue import with_sql
from catalith.plans.define import Plans
from catalith.sources.shared import new_path
from catalith.sources.tables import PRODUCT_SQL, products

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

KEYS = {"size": "number", "wireless": "boolean", "colour": "string", "ports": "string", "tags": "list", "width": "string"}


def typed(spark, sf) -> TypedSpecs:
    return TypedSpecs(spark, new_path(spark, "specs"), KEYS).write(products(spark, sf), ["category", "id"])


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, price FROM product WHERE category = 'PROMO' AND colour = 'red' AND size BETWEEN 5 AND 30 AND wireless")
def p7_p10_typed_filters(spark, sf):
    """Equality, range and boolean filters, all of which Parquet is given."""
    t = typed(spark, sf)
    return t.read().filter((F.col("category") == "PROMO") & t.is_("colour", "red") & t.between("size", 5, 30) & t.is_("wireless", "true")).select("id", "price")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, size FROM product WHERE (size = 3 OR size BETWEEN 10 AND 20 OR size <= 2 OR size >= 45) AND (ports = '4' OR ports = 'n/a') AND (colour = 'blue' OR kind = 'blue' OR colour = 'red' OR kind = 'red')")
def p11_p13_typed_values(spark, sf):
    """Lists of values and ranges, and items of a list."""
    t = typed(spark, sf)
    return t.read().filter(t.among("size", "3,10-20,-2,45-") & t.among("ports", "4, n/a") & t.among("tags", "blue,red")).select("id", F.col("spec_size").cast("int").alias("size"))


@P.query(f"""{with_sql(PRODUCT_SQL)}, f AS (SELECT *, colour IN ('red', 'blue') AS pc, size BETWEEN 5 AND 40 AS ps, wireless AS pw FROM product WHERE enabled)
SELECT 'brand' AS key, brand AS value, count(*) AS n, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM f WHERE pc AND ps AND pw GROUP BY 2
UNION ALL SELECT 'colour', colour, count(*), NULL, NULL FROM f WHERE ps AND pw GROUP BY 2
UNION ALL SELECT 'wireless', 'true', count(*), NULL, NULL FROM f WHERE pc AND ps AND pw HAVING count(*) > 0
UNION ALL SELECT 'size', 'range', count(*), min(size), max(size) FROM f WHERE pc AND ps AND pw HAVING count(*) > 0
UNION ALL SELECT 'size', CASE WHEN size <= 15 THEN 'low' WHEN size <= 30 THEN 'mid' END AS b, count(*), NULL, NULL FROM f WHERE pc AND pw AND size <= 30 GROUP BY b""")
def a1_a5_typed_facets(spark, sf):
    """The facets of a filtered listing from typed columns."""
    t = typed(spark, sf)
    size = t.between("size", 5, 40)
    plain = [Facet("brand", "multi", F.col("brand")), t.facet("colour", "multi", t.among("colour", "red,blue")), t.facet("wireless", "boolean", t.is_("wireless", True)), t.facet("size", "range", size)]
    rows = t.read().filter("enabled")
    bands = [t.facet("size", "buckets", size, (("low", 1, 15), ("mid", 16, 30))), *plain[1:3]]
    return count(rows, plain).union(count(rows, bands).filter("key = 'size'"))


@P.query(f"{with_sql(PRODUCT_SQL)}, f AS (SELECT * FROM product WHERE enabled AND size BETWEEN 5 AND 40), t AS (SELECT id, unnest(list_distinct([colour, kind])) AS tag FROM f) SELECT tag, count(DISTINCT id) AS n, (SELECT count(*) FROM f) AS total FROM t GROUP BY tag")
def a6_typed_list_facet(spark, sf):
    """Products by the items of a list, and how many there are in all."""
    t = typed(spark, sf)
    rows = t.read().filter("enabled").filter(passes([t.facet("size", "range", t.between("size", 5, 40))], []))
    return rows.select(F.explode(F.array_distinct("spec_tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).join(F.broadcast(rows.agg(F.count("*").alias("total"))), F.lit(True))  # one row

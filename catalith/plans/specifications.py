"""Spec extraction, validation, merging and display."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalith.functions.text import start_case
from catalith.operators.merging import vote
from catalith.operators.specs import Mapping, calculated, errors, extract
from catalith.plans.catalogue import with_sql
from catalith.plans.define import Plans
from catalith.sources.tables import PRODUCT_SQL, RECORD_SQL, SOURCE_SQL, products, source_records, sources

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


def raw_specs(spark, sf):
    """Products with raw rows as a scraper would leave them."""
    row = lambda name, section, *values: F.struct(F.lit(name).alias("name"), F.lit(section).alias("sectionTitle"), F.lit(None).cast("string").alias("description"), F.array(*values).alias("values"))
    size = F.col("size")
    raw = F.array(
        row("Width", "Frame", F.format_string("%d.6 mm", size)), row("Resolution", "Panel", F.format_string("%d × %d pixels", size * 64, size * 36)),
        row("Colours", "Frame", F.concat_ws(", ", F.get_json_object("specs", "$.colour"), F.lit("black (matt)"))), row("Wireless", "Radio", F.when(size % 2 == 0, "Yes").otherwise("no")),
        row("Ports", "Radio", F.get_json_object("specs", "$.ports")), row("Finish", "Frame", F.when(size % 3 == 0, "GLS").otherwise("matt")), row("Aspect", "Panel", F.lit("about 16:9 wide")),
    )
    return products(spark, sf).select("id", "size", raw.alias("raw"))


MAPPINGS = [
    Mapping("width", ("breadth", "WIDTH"), "number", section="frame"), Mapping("roundedWidth", ("width",), "roundedNumber"), Mapping("ceiledWidth", ("width",), "ceiledNumber"),
    Mapping("resolution", ("resolution",), "removeWhitespace", suffixes=("pixels",), replace=(("×", "x"),)), Mapping("height", ("resolution",), "secondNumber"),
    Mapping("colours", ("colours",), "list"), Mapping("colourSet", ("colours",), "shuffledList"), Mapping("wireless", ("wireless",), "boolean"), Mapping("ports", ("ports",), "number", skip=("n/a",)),
    Mapping("finish", ("finish",), values={"gls": "glossy", "matt": "matte"}), Mapping("ratio", ("aspect",), "standardRatio"), Mapping("inches", ("width",), "cmToInch"), Mapping("sizes", ("resolution",), "regexpList", patterns=(r"\d+ ×", "nothing")),
]


@P.query(f"""{with_sql(PRODUCT_SQL)} SELECT id, size + 0.6::DOUBLE AS width, floor(size + 1.1)::DOUBLE AS "roundedWidth", (size + 1)::DOUBLE AS "ceiledWidth", (size * 64) || 'x' || (size * 36) AS resolution, (size * 36)::DOUBLE AS height,
[colour, 'black (matt)'] AS colours, list_sort(list_distinct([colour, 'black'])) AS "colourSet", size % 2 = 0 AS wireless, TRY_CAST(ports AS DOUBLE) AS ports, CASE WHEN size % 3 = 0 THEN 'glossy' ELSE 'matte' END AS finish,
'16:9' AS ratio, round((size + 0.6) / 2.54, 2)::DOUBLE AS inches, [(size * 64) || ' ×'] AS sizes FROM product""")
def x1_x15_extract_specs(spark, sf):
    return raw_specs(spark, sf).select("id", *[extract(F.col("raw"), m).alias(m.key) for m in MAPPINGS])


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, true AS has_radio, false AS has_gps FROM product")
def x13_calculated_specs(spark, sf):
    return raw_specs(spark, sf).select("id", calculated(F.col("raw"), ["wireless", "radio"]).alias("has_radio"), calculated(F.col("raw"), ["gps"]).alias("has_gps"))


@P.query(f"""{with_sql(PRODUCT_SQL)} SELECT id, list_filter([CASE WHEN size + 0.6 < 10 THEN 'width: below 10' END, CASE WHEN size + 0.6 > 40 THEN 'width: above 40' END, CASE WHEN size % 3 = 0 THEN 'finish: not allowed' END,
CASE WHEN TRY_CAST(ports AS DOUBLE) IS NULL THEN 'ports: is required' END], lambda x: x IS NOT NULL) AS errors FROM product""")
def x16_validate_specs(spark, sf):
    by = {m.key: m for m in MAPPINGS}
    specs = {k: extract(F.col("raw"), by[k]) for k in ("width", "finish", "ports")}
    return raw_specs(spark, sf).select("id", errors(specs, {"width": {"min": 10, "max": 40}, "finish": {"enum": ["Matte"]}, "ports": {"required": True}}).alias("errors"))


@P.query(f"""{with_sql(RECORD_SQL, SOURCE_SQL)},
c AS (SELECT model_id, 'quantity' AS key, quantity, last_updated, s.priority, record_id * 10 + line AS tie, quantity BETWEEN 10 AND 40 AS ok FROM record r JOIN source s ON s.id = r.source_id),
k AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY model_id) = 1 OR NOT bool_or(ok) OVER (PARTITION BY model_id) OR ok),
g AS (SELECT model_id, quantity, count(*) AS votes, max((last_updated, priority, -tie)) AS newest FROM k GROUP BY 1, 2)
SELECT model_id, 'quantity' AS key, quantity::INTEGER::VARCHAR AS value, votes FROM g QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY votes DESC, newest DESC) = 1""")
def x17_x21_merge_sources(spark, sf):
    """Every source's quantity of a product goes to the vote; 10 to 40 is plausible."""
    s = sources(spark, sf).select(F.col("id").alias("source_id"), "priority")
    c = source_records(spark, sf).join(s, "source_id").select("model_id", F.lit("quantity").alias("key"), F.col("quantity").cast("int").cast("string").alias("value"), "last_updated", "priority", (F.col("record_id") * 10 + F.col("line")).alias("tie"))
    return vote(c, spark.createDataFrame([("quantity", 10.0, 40.0)], "key string, low double, high double"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, ['size', 'colour', 'ports', 'wireless'] AS keys, ['Size', 'Colour', 'Ports', 'Wireless'] AS labels FROM product")
def x22_x23_display_order(spark, sf):
    """Keys by the schema's order, then by name; undeclared keys last."""
    rank = F.create_map(F.lit("size"), F.lit(1), F.lit("colour"), F.lit(2))
    keys = F.filter(F.json_object_keys("specs"), lambda k: k.isin("size", "colour", "wireless", "ports"))
    ranked = F.array_sort(F.transform(keys, lambda k: F.struct(F.coalesce(F.try_element_at(rank, k), F.lit(99)).alias("rank"), k.alias("key"))))
    return products(spark, sf).select("id", F.transform(ranked, lambda r: r["key"]).alias("keys"), F.transform(ranked, lambda r: start_case(r["key"])).alias("labels"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, ['colour', 'size', 'wireless'] AS product_keys, ['ports'] AS offer_keys FROM product")
def x24_o15_split_levels(spark, sf):
    """Product-level and offer-level keys of a spec map."""
    specs = F.from_json("specs", "map<string,string>")
    split = lambda keep: F.array_sort(F.map_keys(F.map_filter(specs, keep)))
    return products(spark, sf).select("id", split(lambda k, v: k.isin("size", "colour", "wireless")).alias("product_keys"), split(lambda k, v: k == "ports").alias("offer_keys"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, CASE WHEN id % 5 = 0 THEN 'Model ' || id ELSE brand END AS brand, CASE WHEN id % 3 = 0 THEN 'teal' ELSE colour END AS colour FROM product")
def x25_contribution_merge(spark, sf):
    """Contributions win over scraped specs key by key; empty names fall back."""
    llm = F.map_from_arrays(F.array(F.lit("colour")), F.array(F.when(F.col("id") % 3 == 0, "teal")))
    merged = F.map_zip_with(llm, F.from_json("specs", "map<string,string>"), lambda k, a, b: F.coalesce(a, b))
    name = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Model "), F.col("id").cast("string"))).otherwise("")
    return products(spark, sf).select("id", F.coalesce(F.nullif(name, F.lit("")), F.col("brand")).alias("brand"), F.try_element_at(merged, F.lit("colour")).alias("colour"))


@P.query(f"""{with_sql(PRODUCT_SQL)}, t AS (SELECT DISTINCT unnest([colour, kind]) AS text FROM product), d AS (SELECT * FROM (VALUES ('red', 'piros'), ('blue', 'kék')) x(text, done)), c AS (SELECT text, 'cached ' || text AS done FROM t WHERE length(text) > 5)
SELECT t.text, coalesce(d.done, c.done) AS translated, CASE WHEN d.done IS NOT NULL THEN 'dictionary' WHEN c.done IS NOT NULL THEN 'cache' ELSE 'model' END AS origin,
CASE WHEN d.done IS NULL AND c.done IS NULL THEN ((row_number() OVER (PARTITION BY d.done IS NULL AND c.done IS NULL ORDER BY t.text) - 1) // 3)::INTEGER END AS chunk FROM t LEFT JOIN d ON d.text = t.text LEFT JOIN c ON c.text = t.text""")
def x29_x30_translation_batch(spark, sf):
    """Distinct values against the dictionary, then the cache; the rest in chunks for the model."""
    tags = F.from_json(F.get_json_object("specs", "$.tags"), "array<string>")
    t = products(spark, sf).select(F.explode(tags).alias("text")).distinct()
    d = F.broadcast(spark.createDataFrame([("red", "piros"), ("blue", "kék")], "text string, by_dictionary string"))
    c = t.filter(F.length("text") > 5).select("text", F.concat(F.lit("cached "), "text").alias("by_cache"))
    both = t.join(d, "text", "left").join(c, "text", "left").withColumn("translated", F.coalesce("by_dictionary", "by_cache"))
    origin = F.when(F.col("by_dictionary").isNotNull(), "dictionary").when(F.col("by_cache").isNotNull(), "cache").otherwise("model")
    place = F.row_number().over(Window.partitionBy("origin").orderBy("text"))
    both = both.withColumn("origin", origin)
    return both.select("text", "translated", "origin", F.when(F.col("origin") == "model", F.floor((place - 1) / 3).cast("int")).alias("chunk"))

"""Name and text functions over products, documents and supplier URLs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.plans.catalogue import with_sql
from catalith.plans.define import Plans
from catalith.sources.tables import PRODUCT_SQL, SOURCE_SQL, products, sources, table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

#: Every function gets names with a size in them, as catalogue names have.
NAMED_SQL = f"{PRODUCT_SQL}, named AS (SELECT id, brand, size, brand || ' ' || upper(display_name) || ' ' || size || ' Q' || id || '-B' AS name FROM product)"


def named(spark, sf):
    return products(spark, sf).select("id", "brand", "size", F.concat(F.col("brand"), F.lit(" "), F.upper("display_name"), F.lit(" "), F.col("size"), F.lit(" Q"), F.col("id"), F.lit("-B")).alias("name"))


@P.query("SELECT doc_id, trim(regexp_replace(lower(text), '[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')) AS text FROM documents")
def f1_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalised(F.col("text")).alias("text"))


FOLDED_SQL = r"""
WITH t AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS t FROM documents),
q AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\x{2018}\x{2019}\x{201A}\x{201B}\x{2032}]', '''', 'g'), '[\x{201C}-\x{201F}\x{2033}\x{AB}\x{BB}]', '"', 'g') AS t FROM t),
d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\x{2014}\x{2015}]', '--', 'g'), '[\x{2010}\x{2011}\x{2013}\x{2212}]', '-', 'g'), '\x{2026}', '...', 'g') AS t FROM q),
w AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\x{2028}\x{2029}]', chr(10), 'g'), '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g') AS t FROM d)
SELECT doc_id, regexp_replace(regexp_replace(t, '[\x{200B}-\x{200F}\x{FEFF}\x{AD}]', '', 'g'), '\\([*_~`\[\]()#+\-!.>])', '\1', 'g') AS text FROM w
"""


@P.query(FOLDED_SQL)
def f2_sanitise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sanitised(T.nfc(F.coalesce("text", F.lit("")))).alias("text"))


@P.query(f"{with_sql(NAMED_SQL)} SELECT id, regexp_replace(regexp_replace(name, '([A-Za-z]) +([0-9])', '\\1\\2', 'g'), '([0-9]) +([A-Za-z])', '\\1\\2', 'g') AS name FROM named")
def f4_model_name(spark, sf):
    return named(spark, sf).select("id", T.model_name(F.col("name")).alias("name"))


@P.query(f"{with_sql(NAMED_SQL)} SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM named")
def f7_f8_slug(spark, sf):
    return named(spark, sf).select("id", T.slug(F.col("name"), F.col("id").cast("string")).alias("slug"))


@P.query(f"""{with_sql(PRODUCT_SQL)}, s AS (SELECT id, replace(display_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY display_name ORDER BY id) AS place FROM product)
SELECT id, CASE WHEN place = 1 THEN slug ELSE slug || '-' || right(id::VARCHAR, 6) END AS slug FROM s""")
def f9_slug_collisions(spark, sf):
    """The first product of a slug keeps it, later ones append the end of their id."""
    from pyspark.sql import Window

    s = products(spark, sf).select("id", T.slug(F.col("display_name")).alias("slug"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return s.withColumn("place", place).select("id", F.when(F.col("place") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.right(F.col("id").cast("string"), F.lit(6)))).alias("slug"))


@P.query(f"""{with_sql(NAMED_SQL)}, w AS (SELECT id, list_filter(list_transform(string_split(substring(name, length(brand) + 2), ' '), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: regexp_matches(x, '[0-9]')) AS w FROM named)
SELECT id, array_to_string(w, ' ') AS key FROM w""")
def f10_digit_words(spark, sf):
    return named(spark, sf).select("id", T.digit_words(F.col("name"), F.col("brand")).alias("key"))


@P.query(f"{with_sql(NAMED_SQL)} SELECT id, trim(substring(name, length(brand) + 1)) AS rest FROM named")
def f12_f13_without_brand(spark, sf):
    return named(spark, sf).select("id", T.without_brand(F.col("name"), F.col("brand")).alias("rest"))


@P.query(f"""{with_sql(NAMED_SQL)} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 -]+', ' ', 'g'), ' +', ' ', 'g'), '([a-z]) +([0-9])', '\\1\\2', 'g'), '([0-9]) +([a-z])', '\\1\\2', 'g')) AS name FROM named""")
def f14_basic_normalisation(spark, sf):
    return named(spark, sf).select("id", T.basic(F.col("name")).alias("name"))


@P.query(f"""{with_sql(NAMED_SQL)}, t AS (SELECT id, regexp_extract_all(lower(name), '[a-z]+|[0-9]+') AS t FROM named),
n AS (SELECT id, t, list_position(list_transform(t, lambda x: regexp_matches(x, '^[0-9]+$')), true) AS first FROM t)
SELECT id, t AS tokens, list_transform(list_filter(list_zip(t, t[2:]), lambda z: regexp_matches(z[1], '^[a-z]+$') AND coalesce(regexp_matches(z[2], '^[0-9]+$'), false)), lambda z: z[1]) AS critical,
  list_filter(t[first + 1:], lambda x: regexp_matches(x, '^[a-z]+$')) AS suffix FROM n""")
def f15_tokens(spark, sf):
    x = F.col("name")
    return named(spark, sf).select("id", T.tokens(x).alias("tokens"), T.critical_alphas(x).alias("critical"), T.suffix_alphas(x).alias("suffix"))


@P.query(f"""{with_sql(NAMED_SQL)}, t AS (SELECT id, unnest(regexp_extract_all(lower(name), '[a-z]+|[0-9]+')) AS t FROM named)
SELECT id, sum(CASE WHEN regexp_matches(t, '[0-9]+') THEN 2.5 WHEN regexp_matches(t, '^q') THEN 1.5 ELSE 1 END)::DOUBLE AS weight FROM t GROUP BY 1""")
def f16_token_weights(spark, sf):
    t = named(spark, sf).select("id", F.explode(T.tokens(F.col("name"))).alias("t"))
    return t.groupBy("id").agg(F.sum(T.token_weight(F.col("t"), [(r"\d+", 2.5), ("^q", 1.5)])).alias("weight"))


@P.query(r"""WITH x AS (SELECT item_id, '[read more](http://x.example) ![pic](a.png) ' || text AS x FROM benchmark)
SELECT item_id, regexp_replace(regexp_replace(x, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS plain, trim(regexp_replace(regexp_replace(x, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM x""")
def f25_f26_markdown_and_punctuation(spark, sf):
    x = F.concat(F.lit("[read more](http://x.example) ![pic](a.png) "), F.left("text", F.length("text")))
    return table(spark, sf, "benchmark").select("item_id", T.without_links(x).alias("plain"), T.without_punctuation(x).alias("bare"))


@P.query(r"""WITH s AS (SELECT item_id, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS s FROM benchmark), w AS (SELECT item_id, s, string_split(s, ' ') AS w FROM s)
SELECT item_id, contains(s, array_to_string(w[1:6], ' ')) AS first, contains(s, w[-1]) AS last, contains(regexp_replace(regexp_replace(s, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'), 'no such phrase as this') AS none FROM w""")
def f27_text_in_source(spark, sf):
    """Whether the first and last words of benchmark items, and a made-up phrase, are in their source."""
    words = F.split(F.trim("text"), r"\s+")
    b = table(spark, sf, "benchmark")
    return b.select("item_id", T.in_source(F.array_join(F.slice(words, 1, 6), " "), F.col("text")).alias("first"), T.in_source(F.element_at(words, -1), F.col("text")).alias("last"), T.in_source(F.lit("no such phrase as this"), F.col("text")).alias("none"))


@P.query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS domain FROM pages")
def f33_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@P.query(f"{with_sql(SOURCE_SQL)} SELECT id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'ref=x1' AS url, regexp_replace(name, '\\s+', '', 'g') AS packed FROM source")
def f35_f45_affiliate_links(spark, sf):
    return sources(spark, sf).select("id", T.affiliate(F.col("url"), "ref", "x1").alias("url"), F.regexp_replace("name", r"\s+", "").alias("packed"))


@P.query(f"""{with_sql(PRODUCT_SQL)} SELECT a.id AS a, b.id AS b FROM product a JOIN product b ON a.brand = b.brand AND a.category = b.category AND a.id < b.id
WHERE a.price = b.price OR abs(a.price::DOUBLE - b.price::DOUBLE) <= 0.05 * greatest(a.price::DOUBLE, b.price::DOUBLE) AND a.size > 40 AND b.size > 40""")
def f37_tolerance(spark, sf):
    p = products(spark, sf).select("id", "brand", "category", F.col("price").cast("double").alias("price"), "size")
    side = lambda df, x, *more: df.select(F.col("id").alias(x), "brand", "category", F.col("price").alias(f"p{x}"), *more)
    # prices within 5 % lie in one step of a little more than that ratio or in neighbouring ones; those that aren't above zero are close to equal ones only
    step = F.floor(F.log("price") / -math.log(0.9499))
    large = p.filter("size > 40 and price > 0")
    a, b = side(large, "a", F.explode(F.array(step - 1, step, step + 1)).alias("step")), side(large, "b", step.alias("step"))
    close = a.join(b, ["brand", "category", "step"]).filter("a < b and pa <> pb").filter(T.within_tolerance(F.col("pa"), F.col("pb")))
    same = p.select(F.col("id").alias("a"), "brand", "category", "price").join(p.select(F.col("id").alias("b"), "brand", "category", "price"), ["brand", "category", "price"]).filter("a < b")
    return same.select("a", "b").unionByName(close.select("a", "b"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, size::DOUBLE AS number, NULL::DOUBLE AS none FROM product")
def f38_standalone_number(spark, sf):
    return products(spark, sf).select("id", T.standalone_number(F.get_json_object("specs", "$.width")).alias("number"), T.standalone_number(F.lit("2 x 4")).alias("none"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, CASE WHEN size % 3 = 0 THEN size || '' ELSE size || ' mm' END AS shown, 'Frame Size' AS label FROM product")
def f42_f43_display(spark, sf):
    unit = F.when(F.col("size") % 3 == 0, "").otherwise(" mm")
    return products(spark, sf).select("id", F.concat(F.col("size").cast("string"), unit).alias("shown"), T.start_case(F.lit("frameSize")).alias("label"))


@P.query("SELECT event_id, CASE event_type WHEN 'view' THEN 'in_stock' WHEN 'click' THEN 'preorder' ELSE 'unknown' END AS availability FROM events")
def f46_availability(spark, sf):
    stock = F.when(F.col("event_type") == "view", "in_stock").when(F.col("event_type") == "click", "preorder").otherwise(F.col("event_type"))
    known = F.when(stock.isin("in_stock", "out_of_stock", "preorder"), stock).otherwise("unknown")
    return table(spark, sf, "events").select("event_id", known.alias("availability"))


@P.query("SELECT event_type, round(sum((value * 100 - value * 20) * 0.3 / 1000 + value * 20 * 0.3 * 0.5 / 1000 + value * 10 * 1.2 / 1000), 4) AS cost FROM events GROUP BY 1")
def f47_a24_token_cost(spark, sf):
    """Input at full price, cached input at half of it, output; summed over calls."""
    total, cached, output = F.col("value") * 100, F.col("value") * 20, F.col("value") * 10
    cost = (total - cached) * 0.3 / 1000 + cached * 0.3 * 0.5 / 1000 + output * 1.2 / 1000
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(cost), 4).alias("cost"))


@P.query("SELECT event_id, least(2 ** (event_id % 9), 60)::DOUBLE AS minutes FROM events WHERE event_type = 'error'")
def f48_backoff(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'error'").select("event_id", T.backoff_minutes(F.col("event_id") % 9).alias("minutes"))


@P.query(f"{with_sql(NAMED_SQL)} SELECT id, len(list_intersect(regexp_extract_all(name, '[0-9]+'), regexp_extract_all(brand, '[0-9]+'))) > 0 AS shares FROM named")
def f49_number_overlap(spark, sf):
    digits = lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))
    return named(spark, sf).select("id", F.arrays_overlap(digits("name"), digits("brand")).alias("shares"))


@P.query(f"""{with_sql(PRODUCT_SQL)}, r AS (SELECT id, [['Frame', 'Colours', colour || ', black (matt)'], ['Frame', 'Finish', CASE WHEN size % 3 = 0 THEN 'GLS' ELSE 'matt' END], ['Frame', 'Width', size || '.6 mm'], ['Panel', 'Aspect', 'about 16:9 wide'],
['Panel', 'Resolution', (size * 64) || ' × ' || (size * 36) || ' pixels'], ['Radio', 'Ports', ports], ['Radio', 'Wireless', CASE WHEN size % 2 = 0 THEN 'Yes' ELSE 'no' END]] AS r FROM product)
SELECT id, sha256('[' || array_to_string(list_transform(r, lambda x: '{{"sectionTitle":"' || x[1] || '","name":"' || x[2] || '","values":["' || x[3] || '"]}}'), ',') || ']') AS hash FROM r""")
def f32_order_free_hash(spark, sf):
    """One hash of a product's raw specs, in whatever order its rows come."""
    from catalith.operators.specs import raw_hash
    from catalith.plans.specifications import raw_specs

    turned = F.when(F.col("id") % 2 == 0, F.reverse("raw")).otherwise(F.col("raw"))
    return raw_specs(spark, sf).select("id", raw_hash(turned).alias("hash"))

"""Names, identities, categories, recall and decisions of resolution, configuration, and specs under a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.functions.similarity import bigram_dice, prefix_words
from catalith.operators.duplicates import merge_direction
from catalith.operators.merging import identity, vote
from catalith.operators.resolution import alias_match, name_list, query_model
from catalith.operators.specs import Mapping, coerced, display_order, errors, translatable
from catalith.operators.vector_index import VectorIndex
from catalith.plans.catalogue import with_sql
from catalith.plans.define import Plans
from catalith.plans.resolving import e6_e13_fuzzy_recall
from catalith.plans.resolving import ORACLES as RESOLVING_SQL
from catalith.sources.shared import new_path
from catalith.sources.tables import PRODUCT_SQL, RECORD_SQL, TASK_SQL, products, source_records, table, tasks

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

ENDS = [" 27-inch OLED Gaming", "-QD-OLED", " 2023 Edition", "- IPS-HDR10", " Panel [VA]", "", " Mini-LED Pro Gen 2"]
MARKETED_SQL = f"""{PRODUCT_SQL}, marketed AS (SELECT id, brand || ' (' || upper(display_name) || ') X' || size || (CASE id % 7 {" ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(ENDS))} END) AS name FROM product)"""


def marketed(spark, sf):
    """Names with brackets and marketing terms, as shops write them."""
    end = F.get(F.array(*map(F.lit, ENDS)), (F.col("id") % 7).cast("int"))
    return products(spark, sf).select("id", F.concat("brand", F.lit(" ("), F.upper("display_name"), F.lit(") X"), "size", end).alias("name"))


def replaced_sql(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


@P.query(f"{with_sql(MARKETED_SQL)} SELECT id, {replaced_sql('name', T.NAME_STEPS)} AS name FROM marketed")
def f5_clean_name(spark, sf):
    return marketed(spark, sf).select("id", T.clean_name(F.col("name")).alias("name"))


@P.query(f"{with_sql(MARKETED_SQL)} SELECT id, trim(regexp_replace(regexp_replace(name, '[()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM marketed")
def f6_tidy_name(spark, sf):
    return marketed(spark, sf).select("id", T.tidy_name(F.col("name")).alias("name"))


@P.query("SELECT doc_id, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) >= 10 AS substantive FROM documents")
def f31_substantive_quote(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.substantive(F.col("text")).alias("substantive"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, size || ' ' || colour || ' ' || kind AS value FROM product")
def f39_spec_value(spark, sf):
    words = F.split("display_name", " ")
    given = F.concat("size", F.lit('" Inch-'), F.upper(words[0]), F.lit(" Version "), F.element_at(words, -1), F.lit(" MM"))
    return products(spark, sf).select("id", T.spec_value(given).alias("value"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, ports <> 'n/a' AS ports, true AS grouped, false AS colour FROM product")
def f44_numeric_only(spark, sf):
    specs = lambda k: F.get_json_object("specs", f"$.{k}")
    return products(spark, sf).select("id", T.numeric_only(specs("ports")).alias("ports"), T.numeric_only(F.concat(F.lit("-1 0"), "size", F.lit(",5"))).alias("grouped"), T.numeric_only(specs("colour")).alias("colour"))


BASIC = [("[^a-z0-9 -]+", " "), (" +", " "), ("([a-z]) +([0-9])", "\\1\\2"), ("([0-9]) +([a-z])", "\\1\\2"), ("^ +| +$", "")]
LISTED_SQL = f"""{PRODUCT_SQL}, given AS (SELECT id, brand, unnest([kind || ' ' || size, brand || ' ' || display_name, upper(display_name), brand || kind || ' ' || size, '']) AS name FROM product),
bare AS (SELECT id, lower(CASE WHEN starts_with(lower(name), lower(brand)) THEN trim(substring(name, length(brand) + 1)) ELSE name END) AS name FROM given WHERE name <> ''),
listed AS (SELECT id, list_sort(list(DISTINCT {replaced_sql('name', BASIC)})) AS names FROM bare GROUP BY id)"""


def listed(spark, sf):
    words = F.split("display_name", " ")
    kind = F.element_at(words, -1)
    aliases = F.array(F.upper("display_name"), F.concat("brand", kind, F.lit(" "), "size"), F.lit(""))
    names = name_list(F.concat_ws(" ", kind, "size"), F.concat_ws(" ", "brand", "display_name"), aliases, F.col("brand"))
    return products(spark, sf).select("id", "brand", names.alias("names"))


@P.query(f"{with_sql(LISTED_SQL)} SELECT id, names FROM listed")
def e25_name_lists(spark, sf):
    """Every product's names as they are compared."""
    return listed(spark, sf).select("id", F.array_sort("names").alias("names"))


@P.query(f"{with_sql(LISTED_SQL)} SELECT a.id, list_has_any(a.names, b.names) AS same FROM listed a JOIN listed b ON b.id = a.id + 64")
def e23_alias_match(spark, sf):
    """Whether a product and the one 64 places on have a name in common."""
    x = listed(spark, sf).select("id", "names")
    return x.join(x.select((F.col("id") - 64).alias("id"), F.col("names").alias("others")), "id").select("id", alias_match(F.col("names"), F.col("others")).alias("same"))


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, CASE id % 4 WHEN 0 THEN kind WHEN 1 THEN colour WHEN 2 THEN brand ELSE display_name END AS model FROM product")
def e27_query_model(spark, sf):
    """The mention's model, else its reference's, else the reference product's, else the display name."""
    at = lambda k, x: F.when(F.col("id") % 4 == k, F.concat(F.lit(" "), x)).when(F.col("id") % 2 == 0, "  ")
    words = F.split("display_name", " ")
    return products(spark, sf).select("id", query_model(at(0, F.element_at(words, -1)), at(1, words[0]), at(2, F.col("brand")), F.col("display_name")).alias("model"))


#: Categories that names may be told by.
MOST_CATEGORIES = 10_000


def resolve_category(mentions, categories, least: float = 0.5):
    """id, category of mentions (id, category, hint): the category given, else the enabled one (categories: category) that the hint names.

    An equal name wins, else the greatest of word, prefix and pair scores from `least` on, the first by name on a tie; null if there is none.
    """
    hints = mentions.filter("category is null and hint is not null").select("hint").distinct()
    x, y = F.col("hint"), F.col("name")
    score = F.when(F.lower(F.trim(x)) == F.lower(y), 2.0).otherwise(F.greatest(T.word_jaccard(x, y), prefix_words(x, y), bigram_dice(x, y)))
    # every hint against every category, which are configured by hand; checked, as nobody sees to it elsewhere
    if categories.count() > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories to tell by name")
    scored = hints.join(F.broadcast(categories.select(F.col("category").alias("name"))), F.lit(True)).withColumn("score", F.round(score, 6)).filter(F.col("score") >= least)
    best = scored.groupBy("hint").agg(F.min_by("name", F.struct((-F.col("score")).alias("s"), "name")).alias("named"))
    return mentions.join(best, "hint", "left").select("id", F.coalesce("category", "named").alias("category"))


@P.query(f"""{with_sql(PRODUCT_SQL)} SELECT id, CASE WHEN id % 3 = 0 OR (id % 3 = 1 AND category IN (SELECT category FROM product WHERE enabled)) THEN category END AS category FROM product""")
def e2_category_resolution(spark, sf):
    p = products(spark, sf)
    mentions = p.select("id", F.when(F.col("id") % 3 == 0, F.col("category")).alias("category"), F.when(F.col("id") % 3 == 1, F.lower("category")).when(F.col("id") % 2 == 0, "zzqq").alias("hint"))
    return resolve_category(mentions, p.filter("enabled").select("category").distinct())


@P.query(f"""WITH fuzzy AS ({RESOLVING_SQL['e6_e13_fuzzy_recall']}), {PRODUCT_SQL}, open AS (SELECT id FROM product WHERE id % 11 = 0 AND id NOT IN (SELECT query_id FROM fuzzy WHERE score >= 0.9)),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS candidate_id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM v q JOIN open ON open.id = q.vec_id JOIN v ON v.vec_id <> q.vec_id)
SELECT query_id, candidate_id FROM s WHERE similarity > 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) <= 5""")
def e7_embedding_recall(spark, sf):
    """Vectors come in only for the mentions (a stated set) for which trigrams found nothing from 0.9 on."""
    settled = e6_e13_fuzzy_recall(spark, sf).filter("score >= 0.9").select(F.col("query_id").alias("id")).distinct()
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    open_ = products(spark, sf).filter("id % 11 = 0").select("id").join(settled, "id", "left_anti")
    index = VectorIndex(spark, new_path(spark, "recall")).build(v.withColumnRenamed("embedding", "vector"), lists=16)
    asked = v.join(open_, "id").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = index.search(asked, 6, None, 0.2).filter("query_id <> id")  # a mention's own vector is among its six nearest
    return found.filter("rank <= 6").select("query_id", F.col("id").alias("candidate_id"))


@P.query(f"""{with_sql(RECORD_SQL)}, cell AS (SELECT model_id, last_updated, source_id % 5 AS priority, -(record_id * 10 + line) AS t, unnest(['brand', 'model', 'display_name', 'release_year']) AS field,
unnest(['B' || source_id % 3, flag, CASE WHEN line % 2 = 0 THEN '' ELSE flag || ' ' || source_id % 2 END, (2010 + quantity::INTEGER % 3)::VARCHAR]) AS value FROM record),
g AS (SELECT model_id, field, lower(value) AS same, count(*) AS votes, max((last_updated, priority, t)) AS newest, arg_max(value, (last_updated, priority, t)) AS value FROM cell WHERE value <> '' GROUP BY 1, 2, 3),
w AS (SELECT model_id, field, value FROM g QUALIFY row_number() OVER (PARTITION BY model_id, field ORDER BY votes DESC, newest DESC) = 1)
SELECT r.model_id, max(value) FILTER (WHERE field = 'brand') AS brand, max(value) FILTER (WHERE field = 'model') AS model, max(value) FILTER (WHERE field = 'display_name') AS display_name, max(value) FILTER (WHERE field = 'release_year') AS release_year
FROM (SELECT DISTINCT model_id FROM record) r LEFT JOIN w ON w.model_id = r.model_id GROUP BY 1""")
def a17_identity_vote(spark, sf):
    """What a product's source records agree on as its brand, model, display name and year."""
    r = source_records(spark, sf)
    given = {"brand": F.concat(F.lit("B"), F.col("source_id") % 3), "model": F.col("flag"), "display_name": F.when(F.col("line") % 2 == 0, "").otherwise(F.concat("flag", F.lit(" "), F.col("source_id") % 2)), "release_year": 2010 + F.col("quantity").cast("int") % 3}
    return identity(r.select("model_id", "last_updated", (F.col("source_id") % 5).alias("priority"), (F.col("record_id") * 10 + F.col("line")).alias("tie"), *[v.alias(k) for k, v in given.items()]), list(given))


@P.query(f"""{with_sql(PRODUCT_SQL)}, c AS (SELECT id, id * 37 % 1000 AS made FROM product) SELECT a.id AS a, b.id AS b, CASE WHEN a.made <= b.made THEN b.id ELSE a.id END AS source, CASE WHEN a.made <= b.made THEN a.id ELSE b.id END AS target FROM c a JOIN c b ON b.id = a.id + 1000 OR b.id = a.id + 1""")
def g5_merge_direction(spark, sf):
    """The older product of a pair stays, the first on a tie."""
    c = products(spark, sf).select("id", (F.col("id") * 37 % 1000).alias("made"))
    a = c.select(F.col("id").alias("a"), F.col("made").alias("made_a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 1000)).alias("b"))
    source, target = merge_direction("a", "b", "made_a", "made_b")
    return a.join(c.select(F.col("id").alias("b"), F.col("made").alias("made_b")), "b").select("a", "b", source.alias("source"), target.alias("target"))


SCHEMA = {"size": {"type": "number", "min": 3, "max": 45, "required": True}, "width": {"type": "number"}, "wireless": {"type": "boolean"}, "tags": {"type": "array"}, "colour": {"type": "string"}}


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, size::DOUBLE AS size, size::DOUBLE AS width, wireless, [colour, kind] AS tags, colour FROM product")
def x14_schema_coercion(spark, sf):
    """Specs as the types that the schema declares; ports, which it doesn't, go."""
    return products(spark, sf).select("id", coerced(F.from_json("specs", "map<string,string>"), SCHEMA).alias("s")).select("id", "s.*")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, size BETWEEN 3 AND 45 AS accepted, CASE WHEN size < 3 THEN ['size: below 3'] WHEN size > 45 THEN ['size: above 45'] ELSE [] END AS errors FROM product")
def g16_manual_specs(spark, sf):
    """Specs entered by hand are taken only if nothing is wrong with them; all faults are named."""
    rows = products(spark, sf).select("id", coerced(F.from_json("specs", "map<string,string>"), SCHEMA).alias("s"))
    wrong = errors({k: F.col(f"s.{k}") for k in SCHEMA}, SCHEMA)
    return rows.select("id", (F.size(wrong) == 0).alias("accepted"), wrong.alias("errors"))


@P.query(f"""{with_sql(RECORD_SQL)}, c AS (SELECT model_id, flag, last_updated, source_id % 5 AS priority, -(record_id * 10 + line) AS t, flag <> 'R' AS ok FROM record),
k AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY model_id) = 1 OR NOT bool_or(ok) OVER (PARTITION BY model_id) OR ok),
g AS (SELECT model_id, flag, count(*) AS votes, max((last_updated, priority, t)) AS newest FROM k GROUP BY 1, 2)
SELECT model_id, flag, votes FROM g QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY votes DESC, newest DESC) = 1""")
def x18_x19_allowed_and_lists(spark, sf):
    """Values outside the allowed ones count only if there are no others; lists agree whatever the order of their items."""
    r = source_records(spark, sf)
    value = F.when(F.col("line") % 2 == 0, F.format_string('["x", "%s"]', F.upper("flag"))).otherwise(F.format_string('["%s","X "]', F.lower("flag")))
    votes = vote(r.select("model_id", F.lit("flags").alias("key"), value.alias("value"), "last_updated", (F.col("source_id") % 5).alias("priority"), (F.col("record_id") * 10 + F.col("line")).alias("tie")),
                 spark.createDataFrame([("flags", None, None, [f'["{a}","{b}"]' for a, b in (("x", "a"), ("a", "x"), ("x", "n"), ("n", "x"))])], "key string, low double, high double, allowed array<string>"))
    return votes.select("model_id", F.upper(F.regexp_extract("value", "([anrANR])", 1)).alias("flag"), "votes")


@P.query(f"{with_sql(PRODUCT_SQL)} SELECT id, ['wireless', 'colour', 'ports', 'size', 'tags', 'width'] AS keys FROM product WHERE category = 'PROMO'")
def x23b_resort_category(spark, sf):
    """The display order of a category's products after its schema has changed; other categories stay."""
    changed = {"wireless": 1, "tags": None}
    order = {k: v for k, v in changed.items() if v is not None}
    return products(spark, sf).filter("category = 'PROMO'").select("id", display_order(F.json_object_keys("specs"), order).alias("keys"))


MAPPINGS = [Mapping("width", ("width",), "number"), Mapping("colour", ("colour",), values={"red": "crimson"})]


@P.query(f"{with_sql(PRODUCT_SQL)}, c AS (SELECT id, unnest(['colour', 'ports', 'size', 'width']) AS key, unnest([colour, ports, size::VARCHAR, size || ' mm']) AS value FROM product) SELECT id, key, value FROM c WHERE (key = 'colour' AND value NOT IN ('red', 'crimson')) OR (key = 'ports' AND value = 'n/a')")
def x29_translatable(spark, sf):
    """Values for translation: no numbers, nothing of numeric modes, nothing that the value map knows."""
    cells = products(spark, sf).select("id", F.explode(F.from_json("specs", "map<string,string>")).alias("key", "value")).filter("key in ('colour', 'ports', 'size', 'width')")
    return cells.filter(translatable(MAPPINGS, F.col("key"), F.col("value"))).select("id", "key", "value")


@P.query(f"""{with_sql(PRODUCT_SQL)}, c AS (SELECT category, unnest(['brand', 'colour', 'wireless', 'total']) AS field, unnest([brand, colour, wireless::VARCHAR, '']) AS value FROM product WHERE enabled)
SELECT category, field, value, count(*) AS n FROM c GROUP BY 1, 2, 3 UNION ALL SELECT DISTINCT category, 'primary', 'size', NULL FROM product WHERE enabled""")
def q5_filter_config(spark, sf):
    """What a category page needs for its filters: primary specs, and if asked for, values with counts, brands and the total, in one pass."""

    def config(rows, primary: list[str], fields: dict, collect: bool):
        known = rows.select("category").distinct().select("category", F.lit("primary").alias("field"), F.explode(F.array(*map(F.lit, primary))).alias("value"), F.lit(None).cast("long").alias("n"))
        if not collect:
            return known
        cells = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()])
        return rows.select("category", F.explode(cells).alias("c")).select("category", "c.*").groupBy("category", "field", "value").agg(F.count("*").alias("n")).unionByName(known)

    spec = lambda k: F.get_json_object("specs", f"$.{k}")
    return config(products(spark, sf).filter("enabled"), ["size"], {"brand": F.col("brand"), "colour": spec("colour"), "wireless": spec("wireless"), "total": F.lit("")}, True)


@P.query(f"""{with_sql(TASK_SQL)}, l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2)) AS title FROM pages),
f AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) || href AS url FROM l WHERE lower(trim(title)) IN ('the', 'and', 'of', 'und', 'de', 'la'))
SELECT url, 'list' AS queue, 'pending' AS status, 0 AS attempts FROM f WHERE length(url) % 5 <> 0""")
def t13_full_sync(spark, sf):
    """Links of the discovery pages whose title is wanted become list tasks, once each, without those in flight."""
    from catalith.operators.sync import full_sync

    titles = spark.createDataFrame([(t,) for t in ("The", "and", "of", "und", "de", "la")], "title string")
    pages = table(spark, sf, "pages").select("url", "html")
    found = full_sync(pages, titles, None)
    inflight = found.filter(F.length("url") % 5 == 0).select("url")
    return full_sync(pages, titles, inflight)

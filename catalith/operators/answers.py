"""Answers of language models as columns: code fences off, extra properties off, values that aren't allowed set right, checked against a JSON schema; and contributions to products made of them.

Documents are read as VARIANT, which keeps a property that is null apart from one that isn't there. Schemas are dictionaries with type, properties, required, items and enum; they shape the columns, so nothing of them is read for each row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean"}
SHAPES = {"string": "STRING", "number": r"(BIGINT|DECIMAL\(.*\)|DOUBLE|FLOAT)", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>"}


def unfenced(text: Column) -> Column:
    """The text without the code fence around it; nothing is an empty object."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^```(?i:json)?\s*", ""), r"\s*```\s*$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("{}"))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^{SHAPES[kind]}$"), F.lit(False))


def _allowed(v: Column, schema: dict) -> Column:
    return F.coalesce(_is(v, "string") & F.try_variant_get(v, "$", "string").isin(*schema["enum"]), F.lit(False))


def value(v: Column, schema: dict, required: bool = False, strict: bool = False) -> Column:
    """The document as a column of the schema's shape. Unless strict, a value that an enum doesn't allow becomes the enum's last one, as does a required one that isn't there; null stays null."""
    if "enum" in schema:
        last = F.lit(None).cast("string") if strict else F.lit(schema["enum"][-1])
        missing = last if required else F.lit(None).cast("string")
        return F.when(v.isNull(), missing).when(F.is_variant_null(v), None).when(_allowed(v, schema), F.try_variant_get(v, "$", "string")).otherwise(last)
    if schema["type"] == "array":
        return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: value(x, schema["items"], False, strict))
    if schema["type"] == "object":
        must = schema.get("required", [])
        parts = [value(_at(v, f"$.{k}"), s, k in must, strict).alias(k) for k, s in schema["properties"].items()]
        return F.when(_is(v, "object"), F.struct(*parts))
    return F.try_variant_get(v, "$", PLAIN[schema["type"]])


def valid(v: Column, schema: dict, required: bool = False, strict: bool = False) -> Column:
    """Whether the document, set right by value(), meets the schema: types, required properties, allowed values; a property that isn't there meets it if it isn't required."""
    if "enum" in schema:
        there = _allowed(v, schema) if strict else ~F.is_variant_null(v)
        return F.when(v.isNull(), F.lit(not required or not strict)).otherwise(there)
    found = _is(v, schema["type"])
    if schema["type"] == "array":
        found &= F.coalesce(F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: valid(x, schema["items"], True, strict)), F.lit(False))
    if schema["type"] == "object":
        must = schema.get("required", [])
        for k, s in schema["properties"].items():
            found &= valid(_at(v, f"$.{k}"), s, k in must, strict)
    return F.when(v.isNull(), F.lit(not required)).otherwise(found)


def answer(text: Column, schema: dict, strict: bool = False) -> Column:
    """The answer in the schema's shape; null for a text that isn't JSON or doesn't meet the schema."""
    v = F.try_parse_json(unfenced(text))
    return F.when(F.coalesce(valid(v, schema, True, strict), F.lit(False)), value(v, schema, True, strict))


def known_value(text: Column, allowed: tuple[str, ...]) -> Column:
    """The text if it is one of `allowed` as it is written, else null."""
    return F.when(text.isin(*allowed), text)


def contribution(brand: Column, model: Column, specs: Column, release_year: Column, finish: Column) -> Column:
    """What a model's answer contributes to a product, as a struct; null if the answer was cut off or nothing in it is usable.

    Brand and model are trimmed, empty ones count as none; of specs (map of strings) empty values go and the rest is in order of keys, a map without any counts as none.
    """
    plain = lambda x: F.nullif(F.trim(x), F.lit(""))
    kept = F.map_filter(specs, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    ordered = F.when(F.size(kept) > 0, F.map_from_entries(F.array_sort(F.map_entries(kept))))
    some = F.struct(plain(brand).alias("brand"), plain(model).alias("model"), ordered.alias("specs"), release_year.alias("release_year"))
    usable = some["brand"].isNotNull() | some["model"].isNotNull() | some["specs"].isNotNull() | some["release_year"].isNotNull()
    return F.when(usable & ~finish.eqNullSafe(F.lit("length")), some)

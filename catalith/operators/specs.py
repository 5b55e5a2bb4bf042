"""Typed specifications from raw label and value rows: a mapping is compiled into one column for each key.

Raw specs are `array<struct<name, sectionTitle, description, values: array<string>>>`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions.text import numbers, to_boolean

RAW = "array<struct<name:string,sectionTitle:string,description:string,values:array<string>>>"


@dataclass(frozen=True)
class Mapping:
    """How a key is read: labels in order of preference, then skip, value map, suffixes, replacements and the mode."""

    key: str
    labels: tuple[str, ...]
    mode: str = "raw"
    section: str | None = None
    index: int = 0
    skip: tuple[str, ...] = ()
    values: dict[str, str] = field(default_factory=dict)
    suffixes: tuple[str, ...] = ()
    replace: tuple[tuple[str, str], ...] = ()
    patterns: tuple[str, ...] = ()


def lookup(raw: Column, m: Mapping) -> Column:
    """Values of the first label that has any, whatever its case."""

    def of(label: str) -> Column:
        fits = lambda r: (F.lower(F.trim(r["name"])) == label.lower()) & (F.size(r["values"]) > 0) & (F.lit(True) if m.section is None else F.lower(r["sectionTitle"]) == m.section.lower())
        return F.get(F.filter(raw, fits), F.lit(0))["values"]

    return F.coalesce(*map(of, m.labels))


def mapped(values: Column, m: Mapping) -> Column:
    """Replaces values by the map if every one of them is in it; else they stay."""
    if not m.values:
        return values
    table = F.create_map(*[F.lit(x) for k, v in m.values.items() for x in (k.lower(), v)])
    return F.when(F.forall(values, lambda v: F.try_element_at(table, F.lower(v)).isNotNull()), F.transform(values, lambda v: F.try_element_at(table, F.lower(v)))).otherwise(values)


def cleaned(value: Column, m: Mapping) -> Column:
    for s in m.suffixes:
        value = F.when(F.endswith(value, F.lit(s)), F.rtrim(F.left(value, F.length(value) - len(s)))).otherwise(value)
    for a, b in m.replace:
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _number(value: Column, place: int) -> Column:
    found = numbers(value)
    return F.coalesce(F.get(found, F.lit(place)), F.get(found, F.lit(0)) if place else F.lit(None)).try_cast("double")


def _lengths(values: Column, factor: float) -> Column:
    """The first number of each value times factor, to two decimals; values without one are left out."""
    return F.filter(F.transform(values, lambda v: F.round(_number(v, 0) * factor, 2)), lambda x: x.isNotNull())


def extract(raw: Column, m: Mapping) -> Column:
    """The column of a key; null where no label is there or every value is to be skipped."""
    values = F.filter(lookup(raw, m), lambda v: F.trim(v) != "")
    if m.skip:
        low = [s.lower() for s in m.skip]
        values = F.when(~F.forall(values, lambda v: F.lower(v).isin(low)), values)
    values = mapped(values, m)
    one = cleaned(F.coalesce(F.get(values, F.lit(m.index)), F.get(values, F.lit(0))), m)
    many = F.filter(F.transform(F.flatten(F.transform(values, lambda v: F.split(v, ","))), lambda v: F.trim(cleaned(v, m))), lambda v: v != "")
    if m.mode == "raw":
        return one
    if m.mode == "number":
        return _number(one, 0)
    if m.mode == "secondNumber":
        return _number(one, 1)
    if m.mode == "roundedNumber":
        return F.floor(_number(one, 0) + 0.5).cast("double")
    if m.mode == "ceiledNumber":
        return F.ceil(_number(one, 0)).cast("double")
    if m.mode == "removeWhitespace":
        return F.regexp_replace(one, r"\s+", "")
    if m.mode == "boolean":
        return to_boolean(one)
    if m.mode == "list":
        return many
    if m.mode == "shuffledList":  # the order is free; sorted, so that equal inputs give equal results
        return F.array_sort(F.array_distinct(F.transform(many, lambda v: F.trim(F.regexp_replace(v, r"\([^)]*\)", "")))))
    if m.mode == "standardRatio":
        return F.nullif(F.regexp_extract(one, r"(\d+:\d+)", 1), F.lit(""))
    if m.mode == "cmToInch":
        return F.round(_number(one, 0) / 2.54, 2)
    if m.mode == "cmToInchList":
        return _lengths(many, 1 / 2.54)
    if m.mode == "mmToCmAndInchList":
        return F.concat(_lengths(many, 0.1), _lengths(many, 1 / 25.4))
    if m.mode == "regexpList":
        def first_hit(pattern: str) -> Column:
            found = F.transform(values, lambda v: F.array_join(F.regexp_extract_all(v, F.lit(f"({pattern})"), F.lit(1)), ""))
            hit = F.get(F.filter(found, lambda v: v != ""), F.lit(0))
            number = hit.try_cast("double")  # numbers are rounded to two decimals
            return F.when(number.isNotNull() & hit.rlike(r"^\d+\.\d{3,}$"), F.round(number, 2).cast("string")).otherwise(hit)

        return F.array_compact(F.array(*map(first_hit, m.patterns)))
    raise ValueError(f"unknown mode {m.mode}")


def raw_hash(raw: Column) -> Column:
    """SHA-256 of the raw rows as JSON, ordered by section and name, so that their order is free."""
    rows = F.array_sort(F.transform(raw, lambda r: F.struct(r["sectionTitle"].alias("sectionTitle"), r["name"].alias("name"), r["values"].alias("values"))))
    return F.sha2(F.to_json(rows), 256)


def coerced(specs: Column, schema: dict[str, dict]) -> Column:
    """Struct of the declared keys of a map of strings (lists as JSON arrays), each by its type: number, boolean, string or array. Undeclared keys go.

    A number is the first one in the text, a boolean true, yes, y, 1 or false, no, n, 0; others are null. A list as a string has its items joined
    by comma and blank; a single value as an array is its only item.
    """
    out = []
    for key, rule in schema.items():
        value = F.try_element_at(specs, F.lit(key))
        items = F.from_json(F.when(F.startswith(F.ltrim(value), F.lit("[")), value), "array<string>")
        as_text = F.coalesce(F.array_join(items, ", "), F.trim(value))
        kinds = {
            "number": F.nullif(F.regexp_extract(as_text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"), "boolean": to_boolean(as_text), "string": as_text,
            "array": F.when(value.isNotNull(), F.coalesce(F.transform(items, lambda x: F.trim(x)), F.array(F.trim(value)))),
        }
        out.append(kinds.get(rule.get("type"), value).alias(key))
    return F.struct(*out)


def display_order(keys: Column, order: dict[str, int]) -> Column:
    """Keys by the place that a category's schema gives them, then by name; those without a place last."""
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv]) if order else F.create_map().cast("map<string,int>")
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(F.coalesce(F.try_element_at(rank, k), F.lit(2**31 - 1)).alias("rank"), k.alias("key")))), lambda r: r["key"])


def translatable(mappings: list[Mapping], key: Column, value: Column) -> Column:
    """Whether a value is to be translated: not of a numeric mode, not a result of the key's value map, not a number."""
    numeric = {"number", "secondNumber", "roundedNumber", "ceiledNumber", "boolean", "standardRatio", "cmToInch"}
    skip = F.lit(False)
    for m in mappings:
        here = key == m.key
        if m.mode in numeric:
            skip |= here
        elif m.values:
            skip |= here & F.lower(value).isin([v.lower() for v in [*m.values, *m.values.values()]])
    return value.isNotNull() & ~skip & ~value.rlike(r"^[-+]?[\d\s.,]+$")


def errors(specs: dict[str, Column], schema: dict[str, dict]) -> Column:
    """Array of `key: problem` of every key that breaks its schema (type number: min, max; any: enum, required)."""
    found = []
    for key, rule in schema.items():
        value = specs[key]
        if rule.get("required"):
            found.append(F.when(value.isNull(), F.lit(f"{key}: is required")))
        if "min" in rule:
            found.append(F.when(value < rule["min"], F.lit(f"{key}: below {rule['min']}")))
        if "max" in rule:
            found.append(F.when(value > rule["max"], F.lit(f"{key}: above {rule['max']}")))
        if "enum" in rule:
            low = [str(e).strip().lower() for e in rule["enum"]]
            found.append(F.when(value.isNotNull() & ~F.lower(F.trim(value.cast("string"))).isin(low), F.lit(f"{key}: not allowed")))
    return F.array_compact(F.array(*found))


def calculated(raw: Column, needles: list[str]) -> Column:
    """Whether a label or a value of the raw specs holds one of the needles."""
    has = lambda x: F.coalesce(F.lower(x).rlike("|".join(needles)), F.lit(False))
    return F.exists(raw, lambda r: has(r["name"]) | F.exists(F.coalesce(r["values"], F.array().cast("array<string>")), has))

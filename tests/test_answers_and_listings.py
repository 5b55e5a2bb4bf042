"""Answers of language models and administrative lists against plain Python."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from catalith.operators import answers
from catalith.operators.listing import Listing

SCHEMA = {
    "type": "object", "required": ["kind", "score"],
    "properties": {
        "kind": {"enum": ["red", "blue", "other"]}, "side": {"enum": ["left", "none"]}, "score": {"type": "number"}, "note": {"type": "string"}, "ok": {"type": "boolean"},
        "tags": {"type": "array", "items": {"enum": ["a", "b", "z"]}}, "parts": {"type": "array", "items": {"type": "object", "required": ["size"], "properties": {"size": {"enum": ["s", "m"]}, "n": {"type": "number"}}}},
    },
}


def fixed(data, schema):
    """Enums set right and required ones filled, in place; extra properties off."""
    if isinstance(data, list):
        return [schema["items"]["enum"][-1] if "enum" in schema["items"] and x not in schema["items"]["enum"] else fixed(x, schema["items"]) for x in data] if "items" in schema else data
    if isinstance(data, dict) and "properties" in schema:
        out = {}
        for k, s in schema["properties"].items():
            if k not in data:
                if k in schema.get("required", []) and "enum" in s:
                    out[k] = s["enum"][-1]
            elif data[k] is not None and "enum" in s:
                out[k] = data[k] if data[k] in s["enum"] else s["enum"][-1]
            else:
                out[k] = fixed(data[k], s)
        return out
    return data


def meets(x, schema):
    if "enum" in schema:
        return x in schema["enum"]
    kind = schema["type"]
    if kind == "object":
        return isinstance(x, dict) and all(k in x for k in schema.get("required", [])) and all(meets(x[k], s) for k, s in schema["properties"].items() if k in x)
    if kind == "array":
        return isinstance(x, list) and all(meets(e, schema["items"]) for e in x)
    return isinstance(x, {"string": str, "boolean": bool, "number": (int, float)}[kind]) and (kind != "number" or not isinstance(x, bool))


def shaped(x, schema):
    if "enum" in schema or schema["type"] not in ("object", "array"):
        return float(x) if x is not None and schema.get("type") == "number" else x
    if schema["type"] == "array":
        return None if x is None else [shaped(e, schema["items"]) for e in x]
    return {k: shaped(x.get(k), s) for k, s in schema["properties"].items()}


def drawn(rng):
    data = {}
    pick = lambda *x: rng.choice(x)
    for k, some in (("kind", ("red", "green", None, 5)), ("side", ("left", "up")), ("score", (1, 2.5, "x", None)), ("note", ("n", "", 7)), ("ok", (True, "yes")), ("tags", (["a", "q"], [], "a")), ("parts", ([{"size": "m", "n": 1, "more": 2}], [{}], [{"size": "xl"}], [5], [{"n": "x"}])), ("extra", (1,))):
        if rng.random() < 0.7:
            data[k] = some[0] if rng.random() < 0.75 else pick(*some)
    return data


@pytest.mark.parametrize("strict", [False, True])
def test_answers_against_plain_validation(spark, strict):
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        body = json.dumps(drawn(rng))
        texts.append(rng.choice(["{}", "```json\n{}\n```", "```\n{}```", "  ```JSON {} ``` "[2:], "{} "]).replace("{}", body))
    texts += ["", None, "no json", "```json\n```", "[1]", "5", "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["a"].asDict(recursive=True) if r["a"] is not None else None for r in df.select("id", answers.answer(F.col("text"), SCHEMA, strict).alias("a")).collect()}
    some = 0
    for i, t in enumerate(texts):
        bare = re.sub(r"\s*```\s*$", "", re.sub(r"^```(json)?\s*", "", t or "", flags=re.I)).strip() or "{}"
        try:
            data = json.loads(bare)
        except ValueError:
            data = None
        data = data if strict else fixed(data, SCHEMA)
        want = shaped(data, SCHEMA) if data is not None and meets(data, SCHEMA) else None
        some += want is not None
        assert got[i] == want, (t, got[i], want)
    assert 5 < some < 150


@pytest.mark.parametrize(("given", "wanted"), [
    ((" Acme ", "", {"b": "2", "a": "1", "c": " ", "d": None}, 2020, "stop"), ("Acme", None, {"a": "1", "b": "2"}, 2020)), ((None, "X1", None, None, None), (None, "X1", None, None)),
    (("Acme", "X1", {"a": "1"}, 2020, "length"), None), ((" ", "", {"a": ""}, None, "stop"), None), ((None, None, {}, 2021, "stop"), (None, None, None, 2021)),
])
def test_contributions(spark, given, wanted):
    df = spark.createDataFrame([given], "b string, m string, s map<string,string>, y int, f string")
    got = df.select(answers.contribution(*map(F.col, "bmsyf")).alias("c")).first()["c"]
    assert (got if got is None else tuple(got)) == wanted and (got is None or got["specs"] is None or list(got["specs"]) == sorted(got["specs"]))


@pytest.mark.parametrize("ask", [
    {}, {"term": " Ring "}, {"term": "r_d"}, {"term": ""}, {"among": {"kind": ["a", "c"], "n": []}}, {"equal": {"on": True, "kind": None}}, {"either": (["kind", "other"], "b")},
    {"sort": "n", "descending": True, "page": 2, "size": 5}, {"sort": "n", "page": 3, "size": 7}, {"term": "red", "sort": "name", "among": {"kind": ["a"]}, "page": 9},
])
def test_listings(spark, ask):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Red ring", "blue", "RINGS", "rod", None]), rng.choice("abc"), rng.choice("abc"), rng.choice([None, 1, 2, 3]), rng.choice([True, False, None])) for i in range(40)]
    asked = Listing("id", named=("name",), **ask)
    got = asked.of(spark.createDataFrame(rows, "id int, name string, kind string, other string, n int, on boolean")).collect()
    term = (ask.get("term") or "").strip()
    like = lambda x: not term or x is not None and re.search(re.escape(term).replace("_", "."), x, re.I)
    held = [r for r in rows if like(r[1])]
    names = {"id": 0, "name": 1, "kind": 2, "other": 3, "n": 4, "on": 5}
    held = [r for r in held if all(not v or r[names[c]] in v for c, v in ask.get("among", {}).items()) and all(v is None or r[names[c]] == v for c, v in ask.get("equal", {}).items())]
    if "either" in ask:
        held = [r for r in held if ask["either"][1] in (r[2], r[3])]
    if "sort" in ask:
        c = names[ask["sort"]]
        some = sorted((r for r in held if r[c] is not None), key=lambda r: r[0])
        held = sorted(some, key=lambda r: r[c], reverse=ask.get("descending", False)) + [r for r in held if r[c] is None]
    size, page = ask.get("size", 20), ask.get("page", 1)
    want = held[(page - 1) * size : page * size]
    assert {r["id"] for r in got} == {r[0] for r in want} and all((r["total"], r["pages"]) == (len(held), -(-len(held) // size)) for r in got)

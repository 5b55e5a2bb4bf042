"""Typed spec columns: what is read of odd documents, what Parquet is given, and the same rows as from JSON."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from catalith.operators.typed_specs import TypedSpecs, with_columns
from catalith.plans import typed
from catalith.sources.tables import products

SF = "/root/testdata/sf0.001"
KEYS = {"n": "number", "b": "boolean", "s": "string", "l": "list"}


@pytest.mark.parametrize(("text", "wanted"), [
    ('{"n": 5, "b": true, "s": "x", "l": ["a", "b"]}', (5.0, True, "x", ["a", "b"])), ('{"n": "5.5", "b": "false", "s": 7, "l": []}', (5.5, False, "7", [])),
    ('{"n": "wide", "b": "perhaps", "l": "a"}', (None, None, None, None)), ("{}", (None,) * 4), ("no json", (None,) * 4), (None, (None,) * 4), ('{"n": null, "s": null}', (None,) * 4),
])
def test_columns_of_odd_documents(spark, text, wanted):
    df = spark.createDataFrame([(text, 1)], "specs string, n int")
    r = with_columns(df, KEYS).select("n", *[f"spec_{k}" for k in KEYS]).first()
    assert tuple(r)[1:] == wanted and r["n"] == 1


@pytest.mark.parametrize(("key", "text", "wanted"), [("n", "1,5-7,20-", {1, 5, 6, 7, 20, 30}), ("n", "-5", set(range(6))), ("n", "", set(range(8)) | {20, 30}), ("n", "x", set()), ("s", "5-7,v1", {1}), ("l", "i6, i7", {5, 6, 7})])
def test_values_and_ranges(spark, tmp_path, key, text, wanted):
    rows = [(i, f'{{"n": {i}, "s": "v{i}", "l": ["i{i}", "i{i + 1}"]}}') for i in (*range(8), 20, 30)]
    t = TypedSpecs(spark, str(tmp_path / "t"), KEYS).write(spark.createDataFrame(rows, "id int, specs string"), ["id"])
    assert {r["id"] for r in t.read().filter(t.among(key, text)).collect()} == wanted


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_parquet(spark):
    plan = plan_of(typed.p7_p10_typed_filters(spark, SF))
    pushed = re.search(r"PushedFilters: (.*)", plan)[1]
    for wanted in ("EqualTo(category,PROMO)", "EqualTo(spec_colour,red)", "GreaterThanOrEqual(spec_size,5.0)", "LessThanOrEqual(spec_size,30.0)", "EqualTo(spec_wireless,true)"):
        assert wanted in pushed
    read = re.search(r"ReadSchema: (.*)", plan)[1]
    assert "spec_tags" not in read and "specs:" not in read
    assert "Or(" in re.search(r"PushedFilters: (.*)", plan_of(typed.p11_p13_typed_values(spark, SF)))[1]


def test_same_rows_as_from_json(spark):
    t = typed.typed(spark, SF)
    json = lambda k: F.get_json_object("specs", f"$.{k}")
    by_json = products(spark, SF).filter((json("colour") == "red") & json("size").cast("double").between(5, 30)).select("id")
    by_column = t.read().filter(t.is_("colour", "red") & t.between("size", 5, 30)).select("id")
    assert sorted(map(tuple, by_json.collect())) == sorted(map(tuple, by_column.collect())) != []

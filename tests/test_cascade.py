"""Recall, gates and decisions, duplicate evaluation, near texts, configuration: against plain Python or case by case."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from test_resolution import basic, brute, edits

from catalith.functions import text as T
from catalith.operators import duplicates, near_texts, resolution, trigram_join
from catalith.operators.merging import vote
from catalith.operators.resolution import DEFAULT_RULES
from catalith.operators.specs import Mapping, coerced, extract, translatable
from catalith.sources.configs import CategoryConfigs, Settings, load_settings


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def grams(x):
    words = "".join(c if c.isalnum() else " " for c in x.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0


def names(rng, n):
    return [" ".join(rng.choices(["red", "blue", "ring", "rings", "gear", "gears", "bolt"], k=rng.randrange(1, 4))) + rng.choice(["", " 12", " 27"]) for _ in range(n)]


@pytest.mark.parametrize("least", [0.4, 0.7, 1.0])
def test_similar_across_against_brute_force(spark, least):
    rng = random.Random(3)
    left, right = [(i % 2, x) for i, x in enumerate([*names(rng, 60), "", "!!"])], [(i % 2, x) for i, x in enumerate([*names(rng, 60), ""])]
    got = trigram_join.similar_across(spark.createDataFrame(left, "k int, a string"), spark.createDataFrame(right, "k int, b string"), ["k"], least).collect()
    wanted = {(k, a, b): similarity(a, b) for k, a in left for j, b in right if j == k and grams(a) and similarity(a, b) >= least - 1e-12}
    assert {(r["k"], r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx(wanted) and len(wanted) > 5


def test_name_lists_alias_match_and_model(spark):
    none = F.lit(None).cast("string")
    listed = resolution.name_list(F.lit("Acme X 12"), F.lit("ACME Ring"), F.array(F.lit("ring"), F.lit(""), F.lit("acme x-12"), F.lit("??")), F.lit("Acme"))
    assert value(spark, listed) == ["x12", "ring", "x-12"]
    assert value(spark, resolution.name_list(none, F.lit("Ring"), F.lit(None).cast("array<string>"), none)) == ["ring"]
    assert value(spark, resolution.alias_match(listed, F.array(F.lit("ring")))) and not value(spark, resolution.alias_match(listed, F.array(F.lit("x"))))
    assert value(spark, resolution.query_model(F.lit("  "), none, F.lit(" M1 "), F.lit("D"))) == "M1" and value(spark, resolution.query_model(none, none, none, F.lit(" "))) is None


def test_best_parts_is_the_best_of_all_pairs(spark):
    a, b = ["ring12 x", "gear"], ["gears 12", "ring 12", "bolt"]
    got = value(spark, resolution.best_parts(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    wanted = max((brute(x, y, DEFAULT_RULES)[3], brute(x, y, DEFAULT_RULES)[0]) for x, y in itertools.product(a, b))
    assert (got["base"], got["string"]) == pytest.approx(wanted)
    assert value(spark, resolution.best_parts(F.array().cast("array<string>"), F.array(F.lit("x")))) is None
    pairs = spark.createDataFrame([(1, a, b), (2, a, b), (3, [], b), (4, ["bolt"], ["bolt", "bolt"])], "k int, q array<string>, c array<string>")
    found = {r["k"]: r["parts"] for r in resolution.compared(pairs, ["k"], "q", "c").collect()}
    assert found[1] == found[2] == got and found[3] is None and found[4]["base"] == 90


ROW = {"query_id": 1, "candidate_id": 10, "score": 90, "string": 0.9, "spec": 0.5, "comparable": 2, "matching": 2, "primary": 0, "matcher": 0, "critical": False, "suffix_missing": False}
SCHEMA = "query_id long, candidate_id long, score int, string double, spec double, comparable int, matching int, primary int, matcher int, critical boolean, suffix_missing boolean"


def scored(spark, *changes):
    return spark.createDataFrame([tuple((ROW | {"candidate_id": 10 + k} | c).values()) for k, c in enumerate(changes)], SCHEMA)


@pytest.mark.parametrize(("second", "wanted"), [(None, True), ({"comparable": 0}, True), ({"primary": 1}, True), ({"matcher": 1}, True), ({"matching": 1}, True), ({}, False)])
def test_specs_confirm_a_missing_number(spark, second, wanted):
    rows = scored(spark, {"critical": True, "score": 95}, *([] if second is None else [{"score": 80} | second]))
    r = resolution.ranked(rows).select(resolution.first_failed_gate(True, confirmed=resolution.spec_confirmed()).alias("g")).first()
    assert r["g"] == (None if wanted else "critical_numeric_mismatch")


@pytest.mark.parametrize(("best", "second", "wanted"), [({}, None, None), ({"score": 69}, None, "low_confidence_anchored"), ({}, {"score": 81}, "ambiguous_match_anchored"), ({}, {"score": 80}, None), ({"critical": True, "matcher": 1}, None, "critical_numeric_mismatch")])
def test_anchored_gates(spark, best, second, wanted):
    rows = scored(spark, best, *([] if second is None else [second]))
    assert resolution.ranked(rows).select(resolution.first_failed_anchored(False, confirmed=resolution.spec_confirmed()).alias("g")).first()["g"] == wanted


@pytest.mark.parametrize(("strict", "changes", "wanted"), [
    (True, [{"score": 95}, {"score": 91}, {"score": 89}], [0, 1]), (False, [{"score": 72}, {"score": 70}, {"score": 69}], [0, 1]), (True, [{"score": 79}], []),
    (True, [{"string": 1.0, "score": 10}, {"score": 85}], [0, 1]), (True, [{"string": 1.0, "score": 99, "primary": 1}], []), (False, [{"string": 1.0, "score": 9, "primary": 1}], [0]),
    (True, [{"primary": 1}], []), (False, [{"primary": 1}], [0]), (True, [{"matcher": 3}], []), (True, [{"critical": True, "matcher": 1}], []), (True, [{"critical": True}], [0]),
    (True, [{"suffix_missing": True}], []), (False, [{"suffix_missing": True}], [0]),
])
def test_acceptable(spark, strict, changes, wanted):
    assert sorted(r["candidate_id"] - 10 for r in resolution.acceptable(scored(spark, *changes), strict).collect()) == wanted


def test_decisions_and_cascade(spark):
    rows = scored(spark, {}, {"score": 88}, {"query_id": 2, "score": 20})
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r["query_id"]: (r["decision"], r["reason"], r["accepted"]) for r in resolution.decided(queries, rows, True).collect()}
    assert got == {1: ("matcher_accept", "matcher_accept", [10, 11]), 2: ("matcher_reject", "no_candidates_above_threshold", []), 3: ("matcher_reject", "no_qualifying_candidates", [])}
    assert {r["query_id"]: r["decision"] for r in resolution.decided(queries, rows, True, web_ran=True).collect()}[2] == "llm"
    all_ = scored(spark, {}, {"query_id": 2, "score": 20}, {"query_id": 2, "score": 92}, {"query_id": 1, "score": 99})
    narrow = lambda q: q.join(all_.filter("candidate_id < 12"), "query_id").select("query_id", "candidate_id")
    wide = lambda q: q.join(all_.filter("candidate_id >= 12"), "query_id").select("query_id", "candidate_id")
    found = resolution.cascade(queries, [("narrow", narrow), ("wide", wide)], lambda f: f.join(all_, ["query_id", "candidate_id"]), True).collect()
    assert sorted((r["query_id"], r["strategy"], r["candidate_id"]) for r in found) == [(1, "narrow", 10), (2, "wide", 12)]


def test_duplicate_evaluation_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i, n in enumerate(names(rng, 40)):
        rows.append((i, rng.choice(["acme", "bolt"]), "c", n, rng.choice([None, n.split()[-1] + " x1"]), [rng.choice(names(rng, 3))], {"size": str(rng.choice([27, 27, 40])), "panel": rng.choice(["va", "ips"])}, rng.choice([None, 2020, 2021]), rng.randrange(8)))
    products = spark.createDataFrame(rows, "id long, brand string, category string, display_name string, model string, aliases array<string>, specs map<string,string>, release_year int, created_at int")
    history = [(i, i + 1, d) for i, d in zip(range(0, 40, 2), itertools.cycle(["rejected", "pending"]), strict=False)]
    limits = duplicates.Limits(review=30, merge=60, non_primary=0)
    got = {(r["a"], r["b"]): r for r in duplicates.evaluate(products, spark.createDataFrame(history, "a long, b long, decision string"), ["brand", "category"], ["size"], ["panel"], limits).collect()}

    def listed(r):
        bare = lambda x: x[len(r[1]) :].strip() if x.lower().startswith(r[1]) else x
        return [x for x in dict.fromkeys(basic(bare(n)) for n in [r[4], r[3], *r[5]] if n) if x]

    wanted = {}
    for x, y in itertools.combinations(rows, 2):
        if x[1] != y[1] or similarity(x[3], y[3]) < 0.4 or (x[0], y[0], "rejected") in history:
            continue
        q, c = (x, y) if x[8] >= y[8] else (y, x)
        best = max((brute(m, n, DEFAULT_RULES)[3], brute(m, n, DEFAULT_RULES)[0], m, n) for m in listed(q) for n in listed(c))
        primary, other = x[6]["size"] != y[6]["size"], x[6]["panel"] != y[6]["panel"]
        wanted[x[0], y[0]] = (best[0], primary, other, y[0] if x[8] <= y[8] else x[0], x[7] and y[7] and x[7] != y[7])
    some = 0
    for k, (base, primary, other, source, years) in wanted.items():
        low, high = base - 30 - 20 * primary - 10 * other, base - 20 * primary - 10 * other  # a missing number and a suffix take 15 each
        assert k in got or low < limits.review, k
        if k in got:
            r = got[k]
            some += 1
            assert r["score"] in {min(max(x, 0), 100) for x in (low, low + 15, high)} and r["score"] >= limits.review
            reasons = [n for n, on in (("score", r["score"] < limits.merge), ("primary spec", primary), ("other specs", other), ("release year", years)) if on]
            assert r["reasons"] == reasons and r["decision"] == ("pending" if reasons else "auto_merged") and r["source"] == source and {r["source"], r["target"]} == set(k)
    assert set(got) <= set(wanted) and some > 10
    capped = duplicates.capped(products.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") % 5).alias("score"), F.lit("auto_merged").alias("decision")), 7).collect()
    assert [(r["score"], r["a"], r["place"]) for r in capped] == [(4, 5 * k + 4, k + 1) for k in range(7)]


def dice(a, b):
    x, y = "".join(a.split()), "".join(b.split())
    if x == y:
        return 1.0
    p, q = ([s[i : i + 2] for i in range(len(s) - 1)] for s in (x, y))
    return 2 * sum(min(p.count(g), q.count(g)) for g in set(p)) / (len(p) + len(q)) if p and q else 0.0


def test_near_texts_against_brute_force(spark):
    rng = random.Random(12)
    texts = [None, "", " ", "a", "ab", "a b", "b", "abc", "abcd", "xabcdx", "Hello  World", "hello world", "say hello world again"]
    for _ in range(60):
        w = rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=rng.randrange(2, 9))
        texts += [" ".join(w), " ".join([rng.choice(["x", "zeta"]), *w])][: rng.randrange(1, 3)]
    rows = list(enumerate(texts))
    norm = {i: " ".join(t.lower().split()) for i, t in rows if t is not None}
    near = lambda x, y: x == y or (bool(x and y) and (x in y or y in x or dice(x, y) >= 0.9))
    wanted = {(a, b) for a, b in itertools.combinations(norm, 2) if near(norm[a], norm[b])}
    got = [tuple(r) for r in near_texts.near_texts(spark.createDataFrame(rows, "id long, text string")).collect()]
    assert set(got) == wanted and len(got) == len(wanted) and len(wanted) > 30


@pytest.mark.parametrize(("longer", "shorter"), [("the quick brown fox jumps over", "quick brown"), ("the quick brown fox jumps over", "quicc browm fox"), ("the quick brown fox jumps over", "lazy dog lies"), ("short", "much longer text"), ("", "x"), ("abc", "abc"), ("One, two; three four five.", "two three"), ("aaa bbb ccc ddd eee", "bbc ccd")])
def test_contains_near(spark, longer, shorter):
    plain = lambda x: " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in x.lower()).split())
    x, y = plain(longer), plain(shorter)
    ratio = lambda a, b: 1 - edits(a, b) / max(len(a), len(b))
    best = max((ratio(y, x[i : i + k]) for k in range(max(1, int(len(y) * 0.8)), min(len(x), -(-len(y) * 12 // 10)) + 1) for i in range(len(x) - k + 1) if i == 0 or x[i - 1] == " "), default=0)
    wanted = bool(x and y and len(y) < len(x) and len(y) / len(x) <= 0.75 and (y in x or best >= 0.85))
    assert value(spark, near_texts.contains_near(F.lit(longer), F.lit(shorter))) is wanted


@pytest.mark.parametrize(("given", "wanted"), [("Zed 34 (OLED) Gaming", "Zed 34"), ("Zed-QD-OLED", "Zed"), ("Zed 27-inch K9 2024 Edition", "Zed K9"), ("Zed - IPS-HDR10", "Zed"), ("OLED", "OLED"), (None, ""), ("--_Zed__", "Zed"), ("Zed--K", "Zed-K")])
def test_clean_name(spark, given, wanted):
    assert value(spark, T.clean_name(F.lit(given).cast("string"))) == wanted


def test_small_text_functions(spark):
    assert value(spark, T.tidy_name(F.lit(" a (b) [c]  d "))) == "a b c d" and value(spark, T.tidy_name(F.lit(None).cast("string"))) == ""
    assert [value(spark, T.substantive(F.lit(x).cast("string"))) for x in ("0123456789", "  012345678 ", None)] == [True, False, False]
    assert value(spark, T.spec_value(F.lit('27" Inch-Model 144Hz version'))) == "27 144hz"
    assert [value(spark, T.numeric_only(F.lit(x).cast("string"))) for x in ("-1 234,5", "1a", "", ".", None)] == [True, False, False, False, False]
    assert value(spark, T.nfc(F.lit("é"))) == "é" and value(spark, T.slug(F.lit("Café Ångström Ǆ"))).startswith("cafe-angstrom")


def test_configs(spark, tmp_path):
    held = CategoryConfigs(str(tmp_path / "c"))
    assert held.slugs() == [] and held.get("tv") is None
    held.put("tv", "schema", {"properties": {"size": {"type": "number", "meta": {"min": 1, "order": 2}}, "name": {}}})
    assert held.get("tv", "schema")["properties"]["size"]["meta"]["min"] == 1 and held.slugs() == ["tv"]
    assert [tuple(r) for r in held.table(spark).orderBy("key").collect()] == [("tv", "name", "string", None, None, None), ("tv", "size", "number", 2, 1.0, None)]
    (tmp_path / "c" / "tv" / "config.json").write_text('{"a": 1}')
    assert held.get("tv") is None  # a miss is remembered until a reload
    held.reload()
    assert held.get("tv") == {"a": 1}
    with pytest.raises(ValueError, match="unknown kind"):
        held.get("tv", "other")
    folder = tmp_path / "s"
    folder.mkdir()
    assert load_settings(str(folder)) == Settings()
    (folder / "a.json").write_text(json.dumps({"gap": 3, "threshold": "", "accept": None}))
    (folder / "b.json").write_text(json.dumps({"gap": 4}))
    assert load_settings(str(folder)) == Settings(gap=4)
    (folder / "c.json").write_text(json.dumps({"gap": 4.5, "threshold": 2, "x": 1, "accept": True}))
    with pytest.raises(ValueError, match="accept: not a whole number; gap: not a whole number; threshold: not from 0 to 1; x: unknown"):
        load_settings(str(folder))


def test_coercion_votes_and_translatable(spark):
    specs = F.create_map(*[F.lit(x) for x in ("n", "about -1.5 or 2", "b", " YES ", "s", '["a","b"]', "t", " one ", "u", '[" x ","y"]', "z", "gone", "q", "perhaps")])
    got = value(spark, coerced(specs, {"n": {"type": "number"}, "b": {"type": "boolean"}, "s": {"type": "string"}, "t": {"type": "array"}, "u": {"type": "array"}, "q": {"type": "boolean"}, "m": {"type": "array"}}))
    assert got.asDict() == {"n": -1.5, "b": True, "s": "a, b", "t": ["one"], "u": ["x", "y"], "q": None, "m": None}
    rows = [(1, "k", v, d, 0, d) for d, v in enumerate(["IPS", "ips ", "VA", "weird", "weird", "weird"])] + [(2, "k", "weird", 1, 0, 1), (2, "k", "odd", 2, 0, 2)] + [(3, "l", v, d, 0, d) for d, v in enumerate(['["b","A"]', '["a", "b"]', '["c"]'])] + [(4, "n", v, d, 0, d) for d, v in enumerate(["5", "x", "x", "50"])]
    ranges = spark.createDataFrame([("k", None, None, ["ips", "va"]), ("n", None, 10.0, None)], "key string, low double, high double, allowed array<string>")
    won = {r["model_id"]: (r["value"], r["votes"]) for r in vote(spark.createDataFrame(rows, "model_id long, key string, value string, last_updated int, priority int, tie int"), ranges).collect()}
    assert won == {1: ("ips ", 2), 2: ("odd", 1), 3: ('["a", "b"]', 2), 4: ("5", 1)}
    maps = [Mapping("w", ("w",), "number"), Mapping("f", ("f",), values={"GLS": "glossy"})]
    ask = lambda k, v: value(spark, F.coalesce(translatable(maps, F.lit(k), F.lit(v).cast("string")), F.lit(False)))
    assert [ask(*x) for x in (("w", "wide"), ("f", "gls"), ("f", "Glossy"), ("f", "matt"), ("o", "12,5"), ("o", "red"), ("o", None))] == [False, False, False, True, False, True, False]
    raw = F.array(F.struct(F.lit("Size").alias("name"), F.lit(None).cast("string").alias("sectionTitle"), F.lit(None).cast("string").alias("description"), F.array(F.lit("254 mm, 100 mm"), F.lit("none")).alias("values")))
    assert value(spark, extract(raw, Mapping("s", ("size",), "mmToCmAndInchList"))) == [25.4, 10.0, 10.0, 3.94]
    assert value(spark, extract(raw, Mapping("s", ("size",), "cmToInchList"))) == [100.0, 39.37]

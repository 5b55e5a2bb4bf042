"""Near-duplicates, top-k, packing, language ID, toxicity and the pipeline."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalith.llm import language_id, near_dedup, packing, queries, topk, toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(queries.ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows, threshold=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "ABC", "x y"]
    rows, texts = [], []
    for i in range(220):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(texts[-12:]))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 60, 150]))]
        texts.append(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "ABC"), (304, "abc"), (305, "é " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("bands", "component_id", "k1", "id", "words")})
    got = near_dedup.near_duplicates(df).collect()
    wanted = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)
    assert len({c for _, c in wanted.values()}) < len(rows) - 30


def test_near_duplicates_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_dedup.near_duplicates(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for common in (20, 200, 900):
        pool = rng.integers(0, 2**63, 2000 - common, dtype=np.uint64)
        a, b = pool[:1000], pool[1000 - common :]
        s = near_dedup.sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        assert (s != near_dedup._NONE).all()
        true = common / (2000 - common)
        assert abs((s[0] == s[1]).mean() - true) < 5 * (true * (1 - true) / near_dedup.BINS) ** 0.5 + 1e-9
    one = near_dedup.sketches(np.array([0]), np.array([5], np.uint64), 1)
    assert (one != near_dedup._NONE).all()


def set_rows(spark, sets):
    return spark.createDataFrame([(i, c, k, sorted(s)) for i, (c, k, s) in sets.items()], "id long, component long, cluster long, words array<long>")


@pytest.mark.parametrize("threshold", [80, 85])
def test_open_pairs_join_all_that_links_join(spark, threshold):
    rng = random.Random(threshold)
    base = [{rng.randrange(10**6) for _ in range(rng.choice([1, 3, 20, 60]))} for _ in range(9)]
    sets = {}
    for i in range(240):
        s = set(base[i % 9])
        for _ in range(rng.randrange(1 + len(s) // 6)):
            s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and len(s) > 1 else s.add(rng.randrange(10**6))
        sets[i] = (i, rng.choice([i % 9, i % 9, 100 + i % 5, 1000 + i]), s)
    link = {(a, b) for a, (*_, x) in sets.items() for b, (*_, y) in sets.items() if a < b and 100 * len(x & y) >= threshold * len(x | y)}
    got = [(min(r), max(r)) for r in near_dedup._open_pairs(set_rows(spark, sets), threshold).collect()]
    assert len(got) == len(set(got)) and len(link) > 300

    def parts(edges):
        root = {i: i for i in sets}
        for a, b in sorted(edges):
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
        return root

    assert parts(link) == parts(link & set(got))


@pytest.mark.parametrize("n", [200, 400])
def test_form_letters_just_below_the_threshold_are_not_paired(spark, n):
    sets = {i: (i, i % 3, set(range(86)) | {1000 + 10 * i + j for j in range(10)}) for i in range(n)}  # similarity 0.81 of every two
    sets |= {10_000 + i: (10_000 + i, i % 2, sets[i][2] | {-i - 1}) for i in range(5)}
    got = {(min(r), max(r)) for r in near_dedup._open_pairs(set_rows(spark, sets), 85).collect()}
    assert got == {(i, 10_000 + i) for i in range(5)}


def test_banding_keeps_the_chance_of_a_miss():
    assert near_dedup.banding(85) == (48, 8) and near_dedup.banding(80) == (54, 7)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_top_k_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 0.1]) for _ in range(6)]) for i in range(150)] + [(200, None), (201, [float("nan")] * 6), (202, [None] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (250, []), (0, rows_dup := [0.1] * 6)]
    df = spark.createDataFrame([(i, v) for i, v in rows if not (i == 0 and v is not rows_dup)], "vec_id long, embedding array<float>").withColumn("block", F.lit(1))
    clean = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in rows if i is not None and v is not None and (i, v) and all(x is not None and np.isfinite(x) for x in v) and not (i == 0 and v is not rows_dup)}
    wanted = {}
    for q in (i for i in clean if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(clean[q], clean[c], strict=False)), c) for c in clean if c != q)[:5]
        wanted |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(scores)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search_embeddings(df).collect()}
    assert got == wanted
    assert topk.search_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.search_embeddings(spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")).count() == 1


def test_top_k_of_repeated_ids_and_great_scores(spark):
    import duckdb

    r = random.Random(2)
    rows = [(i % 40, [r.choice([0.0, 0.5, -1.0, 0.25]) for _ in range(3)]) for i in range(90)] + [(0, [1.0, 1.0, 1.0])] * 3
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    wanted = sorted(con.sql(queries.OP4_SQL).fetchall())
    got = topk.search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == wanted and len(wanted) == 5
    big = [(0, [2**62, 1]), (1, [2**62, 5]), (2, [-(2**62), 1]), (3, [3, 7])]
    df = spark.createDataFrame(big, "vec_id long, weights array<long>")
    got = {(x["query_id"], x["vec_id"]): x["score"] for x in topk.top_k(df, df.filter("vec_id = 0")).collect()}
    assert got == {(0, 1): 2**63 - 1, (0, 2): -(2**63), (0, 3): 2**63 - 1}


def plain_best_fit(lengths, sizes):
    """The same policy by scanning all bins."""
    bins, sizes, left, out = [], sorted(sizes), sum(lengths), []
    for n in lengths:
        fit = [(cap - used, k) for k, (cap, used) in enumerate(bins) if cap - used >= n]
        if fit:
            k = min(fit)[1]
        else:
            cap = min((packing.bin_cost(s) / min(s, left), s) for s in sizes if s >= n)[1]
            k = len(bins)
            bins.append([cap, 0])
        out.append((k, bins[k][1]))
        bins[k][1] += n
        left -= n
    return out, [next(s for s in sizes if s >= used) for _, used in bins]


def test_best_fit_against_plain_scan():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 8193) if rng.random() < 0.3 else rng.randrange(1, 600) for _ in range(rng.randrange(1, 200))), reverse=True)
        bins, offsets, final = packing.best_fit(lengths, packing.SIZES)
        assert (list(zip(bins, offsets, strict=True)), final) == plain_best_fit(lengths, packing.SIZES)


def test_packing_is_whole(spark):
    rows = [(i, "w " * n) for i, n in enumerate([0, 1, 511, 512, 8191, 8192, 20_000, 3, 3])] + [(50, None), (None, "lost"), (7, "w w w")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin_id", F.lit(1))).collect()
    per = {}
    for r in got:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["length"]
    assert per == {0: 1, 1: 2, 2: 512, 3: 513, 4: 8192, 5: 8193, 6: 20_001, 7: 8, 8: 4, 50: 1}
    bins = {}
    for r in got:
        bins.setdefault((r["bin_id"], r["bin_size"]), []).append((r["bin_offset"], r["length"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size and size == min(s for s in packing.SIZES if s >= at)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


LANGS = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "über straße für schön größe müssen".split(), "cc": "здравствуй мир книга дорога вода".split()}


def test_language_id(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(LANGS[x := rng.choice(list(LANGS))], k=40)), x) for i in range(300)] + [(900, None, "aa"), (901, "12 34 !!", "aa"), (902, "", None), (903, "漢字漢字", None), (904, "DOLOR Ipsum amet", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:300])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["score"] == 0 and got[904]["lang_pred"] == "aa"
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    kept = {r["doc_id"] for r in language_id.keep_known(df, language_id.fit(df)).collect()}
    assert kept == set(range(300)) | {904}
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(none).count() == 0
    assert language_id.predict(df, language_id.fit(none)).filter("lang_pred <> 'und'").count() == 0


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.98


def brute_kernel(a, b):
    """Sum over pairs of equal subsequences of ORDER characters of DECAY to the spans' sum."""
    import itertools

    def spans(s):
        for at in itertools.combinations(range(len(s)), toxicity.ORDER):
            yield "".join(s[i] for i in at), toxicity.DECAY ** (at[-1] - at[0] + 1)

    return sum(x * y for p, x in spans(a) for q, y in spans(b) if p == q)


def test_kernel_against_brute_force():
    words = ["stupid", "stuupid", "st.upid", "pidst", "abcd", "loser", "xloserx"]
    for a in words:
        got = toxicity.kernel(toxicity._codes([a] * len(words), 12, 0), toxicity._codes(words, 12, -1))
        assert got == pytest.approx([brute_kernel(a, b) for b in words])


def toxic_rows(n, rng):
    plain = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "ven") for b in ("lo", "ki", "sun") for c in ("ra", "ne", "dol")]
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(4, 60))
        bad = i % 3 == 0
        if bad:
            for w in rng.sample(["worthless", "stupidity", "pathetic"], 2):
                words.insert(rng.randrange(len(words)), w)
        yield i, " ".join(words), int(bad)


def test_toxicity(spark):
    rows = list(toxic_rows(400, random.Random(3)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (1002, "you w.o.r.t.h.l.e.s.s stuupidity"), (1003, "talora " * 9000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in rows)
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1002]["predicted"] == 1 and got[1003]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    model = toxicity.fit(docs, labels)
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()} == {i for i, _, t in rows if not t} | {1000, 1001, 1003}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.detect(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.detect(docs.limit(0), none).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    r = toxicity.detect(some, labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    right = r.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double")), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert right[0] > 0.97 and right[1] < 0.01


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a brute-force version on what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").rdd.map(tuple).collect())
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    clean = {r["doc_id"] for r in first.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert first.columns == columns and clean == {i for i, p in scores.items() if not p}
    wrong = [i for i, t in labels.items() if (i in clean) == bool(t)]
    assert len(wrong) < 0.1 * len(labels)
    second = corpus_pipeline.STAGES[1][1](spark, first, SF)
    assert second.columns == columns and second.count() > 0.95 * len(clean)
    third = corpus_pipeline.STAGES[2][1](spark, second, SF)
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == {c for _, c in brute_components(rows, 80).values()}
    last = corpus_pipeline.STAGES[3][1](spark, third, SF).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in third.collect()}
    assert sum(r["length"] for r in last) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) + 1 for r in third.collect())
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_dedup_stage_keeps_every_text_of_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a + " end"), (5, b), (5, b), (7, c), (7, b + " end"), (8, None), (8, ""), (None, a)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert got.columns == ["doc_id", "text"]
    wanted = [(1, a), (5, b), (7, c), (8, None), (8, ""), (None, a)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_language_stage_rejects_only_texts_without_letters(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(LANGS[x := rng.choice(list(LANGS))], k=40)), x) for i in range(300)]
    short = [(900, "Re.", None), (901, "A.", None), (902, "In. The.", None), (903, "ü", None), (904, "漢字漢字漢字", None), (905, "i d o l a", None), (906, "мир", None)]
    out = [(950, None, "aa"), (951, "", "aa"), (952, "12 34!", "aa"), (953, " \n", None)]
    df = spark.createDataFrame(rows + short + out, "doc_id long, text string, lang string")
    got = corpus_pipeline.keep_known_languages(spark, df, SF)
    assert {r["doc_id"] for r in df.collect()} - {r["doc_id"] for r in got.collect()} == {950, 951, 952, 953}
    assert got.columns == df.columns and got.count() == len(rows) + len(short)
    said = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(said[i]["score"] > 0 for i in (900, 901, 902, 903, 905, 906)) and (said[903]["lang_pred"], said[906]["lang_pred"]) == ("bb", "cc")


def test_language_stage_decides_which_texts_share_a_bin(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(LANGS[x := rng.choice(list(LANGS))], k=40)), x) for i in range(300)]
    said = [(i, t, None if i % 5 == 0 else next(k for k in LANGS if k != x) if i % 31 == 0 else x) for i, t, x in rows] + [(904, "\u6f22\u5b57\u6f22\u5b57", None), (950, "12 34!", "aa")]
    second = corpus_pipeline.keep_known_languages(spark, spark.createDataFrame(said, "doc_id long, text string, lang string"), SF)
    wanted = {i: x for i, _, x in rows} | {904: None}
    assert {r["doc_id"]: r["lang"] for r in second.collect()} == wanted
    last = corpus_pipeline.pack_bins(spark, second, SF).collect()
    assert {r["doc_id"]: r["lang"] for r in last} == wanted and len(last) == len(wanted)
    bins = {}
    for r in last:
        bins.setdefault(r["bin_id"], []).append(r)
    assert all(len({r["lang"] for r in b}) == 1 and len({r["bin_size"] for r in b}) == 1 and sum(r["length"] for r in b) <= b[0]["bin_size"] for b in bins.values())
    assert all(sorted(r["bin_offset"] for r in b) == [sum(r["length"] for r in sorted(b, key=lambda r: r["bin_offset"])[:k]) for k in range(len(b))] for b in bins.values())
    assert corpus_pipeline.pack_bins(spark, second.limit(0), SF).count() == 0


def test_language_stage_names_every_rejected_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {r["doc_id"] for r in docs.collect() if not any(c.isalpha() for c in r["text"] or "")}
    got = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, docs, SF).collect()}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - got == wanted


def test_language_id_of_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(4)
    words = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for k in range(150)}
    rows = [(k * 4 + j, " ".join(rng.choices(w, k=40)), x) for k, (x, w) in enumerate(words.items()) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert got == {i: x for i, _, x in rows}

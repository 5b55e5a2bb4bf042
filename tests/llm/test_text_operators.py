"""Fingerprints, HTML extraction, chat formatting, token output, pieces: brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from catalith.llm import chat, fingerprints, html_text, queries, sentence_pieces, token_output

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a"), (4, "one two"), (5, "one two"), (6, "x" * 5000), (7, "wörd " * 3000), (8, " \t\n "), (9, "😀 é ü　z")]


def table(spark, rows, schema="doc_id long, text string"):
    """With columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in ("score", "tie", "n_chars", "bands", "words", "block", "id", "next", "sketch", "k1")})


def test_fingerprints_against_brute_force(spark):
    rows = ODD + [(12, "one two"), (20, " ".join(f"w{i}" for i in range(400))), (21, " ".join(f"w{i}" for i in range(1, 401)))]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert edited != t or got[i]["edited_fingerprint"] == got[i]["fingerprint"]
    assert got[4]["fingerprint"] == got[5]["fingerprint"] == got[12]["fingerprint"] and got[4]["near_next"] == 1
    assert got[20]["near_next"] > 0.9


def test_fingerprints_syncmers_by_hand(spark):
    """A text's anchors are those of its windows: joining texts keeps both sides' anchors."""
    words = [f"w{i * i % 97}" for i in range(60)]
    a, b = " ".join(words[:40]), " ".join(words)
    got = [r["sketch"]["w"] for r in fingerprints.fingerprints(table(spark, [(1, a), (2, b)])).orderBy("doc_id").collect()]
    assert set(got[0]) <= set(got[1]) and 5 < len(got[0]) < 36


def test_fingerprints_of_no_rows_and_repeated_rows(spark):
    assert fingerprints.edited_fingerprints(table(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(table(spark, [(1, "a b"), (1, "a b"), (None, "c")])).count() == 3


@pytest.mark.parametrize(("page", "wanted"), [
    (None, ""), ("", ""), ("just text", "just text"), ("<p></p>", ""), ("<article><p>One  two\n three<br>four</p><p>&lt;b&gt; &amp; &eacute;</article>", "One two three four\n<b> & é"),
    ("<header>Top</header><nav><a>x</a></nav><main><h1>T</h1><p>Body text</p><aside>side</aside><form>f<input></form></main><footer>f</footer>", "T\nBody text"),
    ("<article><p>Text<script>var a='</p>';</script><style>p{}</style><!-- c --> more</p><section class='comments'><p>I disagree</p></section></article>", "Text more"),
    ("<div class='cookie-notice'>We use cookies</div><article><p>A</p><div class='ad'>Buy</div><p>B</p></article><div id='sidebar'>x</div>", "A\nB"),
    ("<body class='no-sidebar'><div class='menu'><a>m</a></div><div>A long first paragraph of the page.</div><div>Another paragraph that is long too.</div>", "A long first paragraph of the page.\nAnother paragraph that is long too."),
    ("<nav><li>a<li>b<article><p>x</article>", "x"),
])
def test_main_text(page, wanted):
    assert html_text.main_text(page) == wanted


def test_smoothing_and_threshold():
    assert html_text.smoothed([5.0] * 9) == pytest.approx([5.0] * 9)
    s = html_text.smoothed([0, 0, 9, 0, 0])
    assert s[2] == max(s) and s[1] == pytest.approx(s[3])
    assert 2 < html_text.threshold([1, 1, 2, 100, 110, 90]) < 90
    assert html_text.threshold([10, 11, 12]) == 10


def test_extract_rows(spark):
    rows = [(1, "u", "<p>é</p>"), (2, None, None), (1, "u", "<p>é</p>"), (None, "v", "<p>" + "long " * 50_000 + "</p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 249_999), (1, 1), (1, 1), (2, 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_is_the_article_of_every_page(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op5_html_extraction(spark, SF).collect()}
    for i, page in pages.items():
        article = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        lines = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.split("</?(?:p|h1)>", article))
        assert got[i] == "\n".join(filter(None, lines))


def chats(spark, said):
    rows = [(c, k, r, t) for c, turns in said.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("x"))


def test_chat_collapse_against_brute_force(spark):
    rng = random.Random(5)
    said = {}
    for c in range(60):
        base = said[rng.choice(list(said))] if said and rng.random() < 0.6 else []
        said[c] = base[: rng.randrange(len(base) + 1)] + [(rng.choice(["user", "Assistant", None]), rng.choice(["a", "b", None, "", "long " * 50])) for _ in range(rng.randrange(1, 4))]
    keep = {}
    for c, turns in said.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in said.values()) or any(o == turns and d < c for d, o in said.items()):
            continue
        keep[c] = "\n".join(f"<|{(r or '').lower()}|>\n{t or ''}" for r, t in turns)
    got = {r["conv_id"]: r["rendered"] for r in chat.format_chats(chats(spark, said)).collect()}
    assert got == keep


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "x"), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (2, 0, "user", "only")]
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, "<|user|>\nfirst\n<|user|>\nsecond"), 2: (1, "<|user|>\nonly")}
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_encoder_equals_the_library():
    e, r = token_output.encoder(token_output.default_tokenizer()), random.Random(3)
    parts = ["a", "B", "the", " ", "  ", "\n", "\t", "é", "'s", "1", ".", " ", "　", "漢", "😀", "\x85", "\x1c", "<|endoftext|>", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3000)]
    wanted = [x.ids + [0] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == wanted


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 16_383, 16_384, 16_385, 60_000])
def test_ans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n), 50_000).astype(np.uint16)
    counts = np.bincount(ids)
    names = np.flatnonzero(counts)
    freq = token_output._normalised(counts[names])
    place = np.zeros(len(counts), np.int64)
    place[names] = np.arange(len(names))
    assert freq.sum() == 1 << token_output.BITS and freq.min() >= 1
    body = token_output.pack_block([7], [ids], place[ids], freq)
    head = token_output.pack_head(names, freq)
    docs, lengths, back = token_output.unpack_block(head, body)
    assert (docs.tolist(), lengths.tolist()) == ([7], [n]) and (back == ids).all()
    last = token_output._BODY.size - 1
    broken = body[:last] + bytes([body[last] ^ 1]) + body[last + 1 :]
    with pytest.raises(ValueError):
        token_output.unpack_block(head, broken)


def test_token_output_against_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_output.default_tokenizer())
    tok.encode_special_tokens = True
    rows = ODD + [(20, "<|endoftext|> hi"), (15, "b"), (14, "!!!")]
    got = {r["doc_id"]: r for r in token_output.round_trip(table(spark, rows), token_output.default_tokenizer()).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_output.round_trip(table(spark, []), token_output.default_tokenizer()).count() == 0
    assert token_output.round_trip(table(spark, [(1, "a"), (1, "a"), (None, "b")]), token_output.default_tokenizer()).count() == 2


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.load(sentence_pieces.default_model())


def test_merge_fold_equals_the_library(spark, pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    texts = [t for _, t in ODD if t is None or len(t) < 1000] + ["hello  world\n x", "<0x0A> <s>", "aaaaaaaaaaaaaaaa", "internationalization, ﬁ 漢字 99.5%", "  lead", "trail  "]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 9 = 0").collect()]
    docs = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in sentence_pieces.decode(sentence_pieces.encode(docs, pieces), pieces).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == model.encode(t or ""), t
        assert got[i]["decoded"] == (t or "")
        assert got[i]["n_tokens"] == len(got[i]["ids"])


def test_every_piece_alone_is_reached_by_merging(pieces):
    """The merge fold's ground: each piece, cut to characters and merged by rank, comes out whole, or the library doesn't give it either."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    rank = {p: -s for p, _, s in pieces.usable}
    for p, i, _ in pieces.usable:
        if len(p) < 2 or not p.startswith("▁") or "▁" in p[1:]:
            continue
        edges = sorted((rank[p[a:b]], a, b) for a in range(len(p)) for b in range(a + 2, len(p) + 1) if p[a:b] in rank)
        nxt = list(range(1, len(p) + 1))
        for _, a, b in edges:
            m = nxt[a]
            if 0 < m < b and nxt[m] == b:
                nxt[a], nxt[m] = b, 0
        assert (nxt[0] == len(p)) == (model.encode(p[1:]) == [i]), p


def test_viterbi_fold_against_brute_force(spark, pieces):
    score = {p: s for p, _, s in pieces.usable}
    least = min(score.values()) - 10
    words = ["▁hello", "▁internationalization", "▁漢x", "▁", "▁aaaaaaa", "▁9.5%"]

    def best(w):
        table_ = [(0.0, 0)] + [(float("-inf"), 0)] * len(w)
        for stop in range(1, len(w) + 1):
            table_[stop] = max((table_[a][0] + score.get(w[a:stop], least if stop == a + 1 else float("-inf")), a) for a in range(max(0, stop - 16), stop))
        return table_[-1][0]

    ids = {i: s for _, i, s in pieces.usable}
    got = sentence_pieces.segmented(spark.createDataFrame([(w,) for w in words], "word string"), pieces, fold="viterbi").collect()
    for r in got:
        if "漢" in r["word"]:
            continue
        assert sum(ids[i] for i in r["ids"]) == pytest.approx(best(r["word"])), r["word"]


def test_pieces_of_no_rows(spark, pieces):
    assert sentence_pieces.encode(table(spark, []), pieces).count() == 0
    assert sentence_pieces.encode(table(spark, [(1, "a"), (1, "a"), (None, None)]), pieces).count() == 3


def test_fingerprints_keep_every_anchor_with_its_place(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    passage = [f"p{r.randrange(10**6)}" for _ in range(60)]
    a, b, c = words, words[:9000] + passage + words[9000:], [f"q{i}" for i in range(8000)] + passage
    got = [x["sketch"]["w"] for x in fingerprints.fingerprints(table(spark, [(i, " ".join(t)) for i, t in enumerate((a, b, c))])).orderBy("doc_id").collect()]
    assert all([x["at"] for x in s] == sorted({x["at"] for x in s}) for s in got) and len(got[0]) > 8000
    hashes = [{x["h"] for x in s} for s in got]
    assert len(hashes[1] - hashes[0]) > 15 and len(hashes[1] & hashes[2]) > 15
    places = {x["h"]: x["at"] for x in got[0]}
    assert all(x["at"] == places[x["h"]] for x in got[1] if x["at"] < 8990) and all(x["at"] == places[x["h"]] + 60 for x in got[1] if x["at"] > 9070)
    near = {x["doc_id"]: x["near_next"] for x in fingerprints.edited_fingerprints(table(spark, [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))])).collect()}
    assert 0.99 < near[1] < 1 and 0 < near[2] < 0.01


def test_token_output_query_equals_the_unchanged_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(token_output.default_tokenizer()), random.Random(5)
    assert tok.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    parts = ["a", "B", " ", "  ", "\n", "é", "'s", "漢", "<|endoftext|>", "<|endoftext", "|>"]
    rows = ODD + [(20, "a <|endoftext|> b"), (21, "<|endoftext|>")] + [(100 + i, "".join(r.choice(parts) for _ in range(r.randrange(12)))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op8_token_output(spark, str(tmp_path)).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def plain_sketch(text):
    """Anchors of a text's words by the definition: windows of K whose least inner hash is at an edge, as (place, words)."""
    words = [w[i : i + fingerprints.WORD] for w in text.split() for i in range(0, len(w), fingerprints.WORD)]
    return words, [(i, tuple(words[i : i + fingerprints.K])) for i in range(len(words) - fingerprints.K + 1)]


def test_fingerprints_against_plain_closed_syncmers(spark):
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(n)) for n in (4, 5, 9, 60, 300)] + ["y" * 90 + " a b c d e"]
    got = {x["doc_id"]: x["sketch"]["w"] for x in fingerprints.fingerprints(table(spark, list(enumerate(texts)))).collect()}
    hashed = {}
    for w in {w for t in texts for w in plain_sketch(t)[0]}:
        hashed[w] = None
    rows = spark.createDataFrame([(w,) for w in hashed], "w string").select("w", F.xxhash64("w")).collect()
    hashed = dict(map(tuple, rows))
    pairs = {(a, b) for t in texts for a, b in zip(plain_sketch(t)[0], plain_sketch(t)[0][1:], strict=False)}
    inner = {(a, b): h for a, b, h in spark.createDataFrame([(a, b, hashed[a], hashed[b]) for a, b in pairs], "a string, b string, x long, y long").select("a", "b", F.xxhash64("x", "y")).collect()}
    for i, t in enumerate(texts):
        words, windows = plain_sketch(t)
        if len(words) < fingerprints.K:
            assert [x["at"] for x in got[i]] == [0]
            continue
        wanted = []
        for at, w in windows:
            m = [inner[p] for p in zip(w, w[1:], strict=False)]
            if min(m[0], m[-1]) <= min(m):
                wanted.append(at)
        assert [x["at"] for x in got[i]] == wanted


def test_next_document_for_any_ids(spark):
    """Ids at both ends of 64 bits, an outlier far from a dense range, one id many times, null ids: the next row and no great run."""
    from catalith.llm import common

    r = random.Random(1)
    ids = [-(2**63), -(2**62) - 5, 3, 2**62 + 5, 2**63 - 1, 10**15, *range(100_000, 106_000), *[77] * 3000, *[None] * 2500]
    rows = [(i, f"t{r.randrange(10**9)}") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    got = fingerprints.with_next(docs).select("doc_id", "tie", "next.doc_id", "next.tie").collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    order = sorted((tuple(x[:2]) for x in got), key=key)
    assert len(got) == len(rows) and {(tuple(x[:2]), tuple(x[2:])) for x in got} == set(zip(order, order[1:] + order[:1], strict=True))
    sizes = [x["count"] for x in docs.groupBy(common.runs(docs, 500)).count().collect()]
    assert max(sizes) < 2000 and len(sizes) > 8
    assert docs.limit(0).groupBy(common.runs(docs.limit(0), 500)).count().count() == 0


def test_rank_costs_give_the_library_ids_for_whole_documents_and_long_words(spark, pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    r = random.Random(7)
    words = ["".join(r.choice("aeinrst") for _ in range(n)) for n in (1, 2, 5, 13, 40, 63, 64, 65, 200, 700)] + ["a" * n for n in (2, 3, 7, 30, 64, 70)] + ["ab" * 20, "the" * 15]
    texts = [*words, " ".join(words), "x" * 3000, "wörd " * 3000, *[r_["text"] for r_ in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 5 = 1").collect()]]
    got = {x["doc_id"]: x["ids"] for x in sentence_pieces.encode(table(spark, list(enumerate(texts))), pieces).collect()}
    assert all(got[i] == model.encode(t or "") for i, t in enumerate(texts))
    both = [sentence_pieces._tokens(spark.createDataFrame([("▁" + w,) for w in words], "word string"), pieces, "rank", long).collect() for long in (0, 100)]
    assert sorted(both[0]) == sorted(both[1])


def test_words_are_cut_only_where_no_piece_goes_on(pieces):
    cutter = sentence_pieces.Cutter(pieces)
    text = "Hello, world!  naïve 漢字 3.14\nx" + "".join(chr(c) for c in range(32, 400))
    words = cutter.words(text)
    assert "".join(words) == ("▁" + text).replace(" ", "▁") and len(words) > 100
    pairs = {p[i : i + 2] for p, *_ in pieces.usable for i in range(len(p) - 1)}
    assert all(a[-1] + b[0] not in pairs for a, b in zip(words, words[1:], strict=False))
    assert cutter.words(None) == cutter.words("") == []


LONG = "This paragraph is long enough that nobody would take it for a link, a label or a button of the page. " * 2
LINKS = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12))


@pytest.mark.parametrize(("body", "wanted"), [
    (f"<ul>{LINKS}</ul><div><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>The end.</p></div><ul>{LINKS}</ul>", f"Head\n{LONG}\nShort.\n{LONG}\nThe end."),
    (f"<ul>{LINKS}</ul><article><a href='/x'>Teaser text</a></article><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}\n{LONG}"),
    (f"<ul>{LINKS}</ul><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p></article>", f"A\n{LONG}\nB\n{LONG}"),
    (f"<form><nav>{LINKS}</nav><article><p>{LONG}</p></article><input></form>", LONG),
    (f"<form><ul>{LINKS}</ul><div><p>{LONG}</p></div></form>", LONG),
    (f"<div class='social-science'><p>{LONG}</p><p>Short.</p></div>", f"{LONG}\nShort."),
    (f"<nav>{LINKS}</nav><article class='menu-item'><h1>T</h1><p>{LONG}</p></article>", f"T\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='related-stories'><p>{LONG}</p></div></article><div class='ad'>{LONG * 5}</div>", LONG),
    (f"<div><p>{LONG}</p></div><div class='comments'><article><p>{LONG * 3}</p></article><article><p>{LONG * 3}</p></article></div>", LONG),
    (f"<div class='reply'>{LONG}</div>", ""), (f"<div role='dialog'>{LINKS}</div><main><p>{LONG}</p></main>", LONG),
])
def test_ratios_choose_the_content(body, wanted):
    lines = [x.strip() for x in wanted.split("\n")]
    assert html_text.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>").split("\n") == lines


def test_the_threshold_decides(monkeypatch):
    page = f"<ul>{LINKS}</ul><div><p>{LONG}</p><p>{LONG * 3}</p></div><p><a>foot</a> <a>note</a></p>"
    usual = html_text.main_text(page)
    assert usual == f"{LONG.strip()}\n{(LONG * 3).strip()}"
    monkeypatch.setattr(html_text, "threshold", min)
    assert "link 3" in html_text.main_text(page)
    monkeypatch.setattr(html_text, "threshold", max)
    assert html_text.main_text(page) == (LONG * 3).strip()


def test_deeply_nested_pages_take_linear_time():
    import time

    began = time.monotonic()
    assert html_text.main_text("<b>" * 20_000 + "<p>x" * 20_000).count("x") == 20_000
    assert time.monotonic() - began < 10


def test_fingerprints_take_one_sketch_for_all_lengths(spark):
    """From 5 words on, whatever the code points: the same anchors in a short text and inside a long one; no two different texts are alike for want of anchors."""
    r = random.Random(12)
    short = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for n in range(1, 9) for _ in range(12)]
    long = short[-1] + " " + " ".join(f"v{i}" for i in range(900))
    got = [x for x in fingerprints.edited_fingerprints(table(spark, list(enumerate([*short, long])))).orderBy("doc_id").collect()]
    assert all(x["fingerprint"] for x in got) and all(x["near_next"] == 0 for x in got[:-2])
    assert got[-1]["fingerprint"].startswith(got[-2]["fingerprint"]) and len(got[-1]["fingerprint"]) < len(long)
    kept = fingerprints.fingerprints(table(spark, [(1, long)])).first()
    at = 0
    for k, anchor in enumerate(kept["sketch"]["w"]):
        low, gap = kept["fingerprint"][9 * k : 9 * k + 8], kept["fingerprint"][9 * k + 8]
        at += int(gap, 16)
        assert (int(low, 16), at) == (anchor["h"] & 0xFFFFFFFF, anchor["at"])


@pytest.mark.parametrize(("body", "wanted"), [
    (f"<header><h1>Site</h1></header><article><header><h1>Headline</h1><p>By A. Writer</p><nav>{LINKS}</nav></header><p>{LONG}</p></article>", f"Headline\n{LONG}"),
    (f"<main><header><h2>Headline</h2></header><p>{LONG}</p></main><header><h2>More</h2></header>", f"Headline\n{LONG}"),
    (f"<main><header class='ad'><h2>Buy</h2></header><p>{LONG}</p></main>", LONG),
    (f"<article><header><h1>One</h1></header><p>{LONG}</p></article><article><header><h1>Two</h1></header><p>{LONG}</p></article>", f"One\n{LONG}\nTwo\n{LONG}"),
])
def test_headlines_in_the_header_of_an_article(body, wanted):
    assert [x.strip() for x in html_text.main_text(f"<body>{body}</body>").split("\n")] == [x.strip() for x in wanted.split("\n")]


def test_piece_query_decodes_every_text(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op7_sentence_pieces(spark, str(tmp_path)).collect()}
    assert {i: x["decoded"] for i, x in got.items()} == {i: t or "" for i, t in ODD}


def moved(spark, query):
    """Bytes that the exchanges of query(spark) write."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def written():
        bus.waitUntilEmpty(30_000)
        held = store.executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.length()))

    start = written()
    query(spark).write.format("noop").mode("overwrite").save()
    return written() - start


def test_piece_query_moves_half_of_its_texts_at_most(spark, tmp_path):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghilmnoprstuv", k=r.randrange(3, 9))) for _ in range(600)]
    texts = [" ".join(r.choices(words, k=250)) for _ in range(3000)]
    table(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    assert moved(spark, lambda s: queries.op7_sentence_pieces(s, str(tmp_path))) < 0.5 * sum(map(len, texts))


def test_pieces_over_several_blocks_and_flushes(spark, pieces, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    monkeypatch.setattr(sentence_pieces, "BLOCK", 1 << 14)
    monkeypatch.setattr(sentence_pieces, "HELD", 50)
    monkeypatch.setattr(sentence_pieces, "DECODED", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(table(spark, [(None, None), (None, "a \u2581b"), (-5, ""), (7, "\u6f22\U0001f600 x"), (7, "\x00")]).select("doc_id", "text"))
    got = sentence_pieces.decode(sentence_pieces.encode(docs.repartition(5), pieces), pieces).collect()
    said = sorted((str(x["doc_id"]), x["ids"]) for x in got)
    assert said == sorted((str(x["doc_id"]), model.encode(x["text"] or "")) for x in docs.collect())
    assert all(x["decoded"] == model.decode(x["ids"]) for x in got)


def test_piece_query_decodes_where_it_has_the_ids(spark, pieces, monkeypatch, tmp_path):
    """One Python worker of a task holds ids and texts, not two; the texts are decode()'s own."""
    monkeypatch.setattr(sentence_pieces, "BLOCK", 1 << 14)
    monkeypatch.setattr(sentence_pieces, "DECODED", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(table(spark, [*ODD, (None, None), (-5, "a \u2581b\x00"), (7, " " * 700)]).select("doc_id", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    query = queries.op7_sentence_pieces(spark, str(tmp_path))
    assert query._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapCoGroupsInArrow")
    plain = sentence_pieces.decode(sentence_pieces.encode(docs, pieces), pieces)
    assert query.schema == plain.schema
    assert sorted(map(str, query.collect())) == sorted(map(str, plain.collect()))


def test_decoding_takes_little_memory(pieces):
    class Held:
        schema = StructType([StructField("ids", ArrayType(IntegerType()))])

        def drop(self, _):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    ids = pa.array(np.random.default_rng(3).integers(300, len(pieces.texts), 1 << 20), pa.int32())
    batch = pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, 1 << 10), pa.int32()), ids)], ["ids"])
    tracemalloc.start()
    try:
        n = sum(x.num_rows for x in sentence_pieces.decode(Held(), pieces)(iter([batch])))
        assert n == 1 << 10 and tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()


def test_decoding_of_odd_lists(spark, pieces):
    rows = [(1, None), (2, []), (3, [1, None, -4, 10**6]), (4, pieces.byte_ids[65:68]), (5, [pieces.byte_ids[0xE6]])]
    got = sentence_pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), pieces)
    assert got.columns == ["doc_id", "ids", "decoded"] and sentence_pieces.decode(got, pieces).columns == got.columns
    assert {x["doc_id"]: x["decoded"] for x in got.collect()} == {1: None, 2: "", 3: pieces.texts[1], 4: "ABC", 5: "\ufffd"}

"""The registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import chat, clustering, fingerprints, html_text, language_id, packing, sentence_pieces, substring_dedup, token_output, topk, toxicity, vector_codes
from catalith.llm.common import table
from catalith.llm.near_dedup import near_duplicates


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that begin no longer one, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of several sizes."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every text, its edited text, and their likeness."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's piece ids by the public model, and the text that they decode to."""
    pieces = sentence_pieces.load(sentence_pieces.default_model())
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), pieces, decoded=True)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids as by the unchanged tokenizer, written as coded blocks and read back."""
    return token_output.round_trip(table(spark, sf_dir, "documents"), token_output.default_tokenizer(), added=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents that aren't held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, learned from the labels that aren't held out."""
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen bytes of code for every vector, from codebooks of 64 entries."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when windows of 35 words that stand elsewhere too are removed."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of sixteen centroids for every vector, after three rounds."""
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_html_extraction": op5_html_extraction,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_token_output": op8_token_output,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}

OP1_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, sha256(coalesce(text, '')) AS digest,
    concat(role IS NULL, text IS NULL) AS nulls, '<|' || lower(coalesce(role, '')) || '|>' || chr(10) || coalesce(text, '') AS said
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(role || chr(1) || digest || nulls ORDER BY turn NULLS FIRST, role, digest, nulls) AS k,
    string_agg(said, chr(10) ORDER BY turn NULLS FIRST, role, digest, nulls) AS rendered
  FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT k[1:n] AS k FROM (SELECT k, unnest(range(1, len(k))) AS n FROM c))
SELECT min(conv_id) AS conv_id, len(k)::BIGINT AS n_turns, min(rendered) AS rendered
FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = c.k) GROUP BY k
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT a AS id, a AS o FROM u
  UNION
  SELECT r.id, u.b FROM r JOIN u ON u.a = r.o),
m AS (SELECT id, min(o) AS component FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component, d.doc_id) AS component_id,
  coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""

_KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARE = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"

OP11_SQL = f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE {_KEPT} AND len(embedding) > 0 AND len(embedding) % 16 = 0),
l AS (SELECT len(v) AS n FROM e GROUP BY 1 ORDER BY count(*) DESC, n DESC LIMIT 1),
k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, v, n // 16 AS s FROM e JOIN l ON len(v) = n),
w AS MATERIALIZED (SELECT r, p, list_slice(v, p * s + 1, p * s + s) AS w FROM (SELECT r, v, s, unnest(range(16)) AS p FROM k)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS i FROM k WHERE vec_id IS NOT NULL QUALIFY i < 64),
b0 AS MATERIALIZED (SELECT p, i, w FROM w JOIN f USING (r)),
""" + "".join(f"""
a{n} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := {_SQUARE.format("w.w", f"b{n}.w")}, i := i)) AS x FROM w JOIN b{n} USING (p) GROUP BY r, p),
""" + (f"""
u{n} AS (SELECT p, x.i AS i, j, floor(sum(w[j]) / count(*))::BIGINT AS c
  FROM (SELECT p, x, w, unnest(range(1, len(w) + 1)) AS j FROM a{n} JOIN w USING (r, p)) GROUP BY ALL),
b{n + 1} AS MATERIALIZED (
  SELECT p, i, coalesce(c, w) AS w FROM b{n} LEFT JOIN (SELECT p, i, list(c ORDER BY j) AS c FROM u{n} GROUP BY p, i) USING (p, i)),
""" if n < 2 else "") for n in range(3)) + """
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, i)) AS h FROM b2),
c AS (SELECT r, string_agg(printf('%02x', x.i), '' ORDER BY p) AS code, sum(x.d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN c USING (r), h
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
s AS (SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s, count(*) OVER (PARTITION BY r) AS n FROM w),
h AS (SELECT r, i, md5(s) AS s FROM s WHERE i + 35 <= n),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM h JOIN (SELECT s FROM h GROUP BY s HAVING count(*) > 1) USING (s)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
"""

OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE {_KEPT} AND len(embedding) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS i, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY i < 16),
""" + "".join(f"""
a{n} AS MATERIALIZED (
  SELECT r, any_value(v) AS v, min(struct_pack(d := {_SQUARE.format("v", "c")}, i := i)) AS x FROM v CROSS JOIN c{n} GROUP BY r),
""" + (f"""
u{n} AS (SELECT x.i AS i, j, floor(sum(v[j]) / count(*))::BIGINT AS c FROM (SELECT x, v, unnest(range(1, 65)) AS j FROM a{n}) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (
  SELECT i, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT i, list(c ORDER BY j) AS m FROM u{n} GROUP BY i) USING (i)),
""" if n < 3 else "") for n in range(4)) + """
f AS (SELECT r, x.i AS i, x.d AS d FROM a3)
SELECT vec_id, f.i::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY f.i)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN v USING (r) JOIN c3 ON c3.i = f.i
"""

ORACLES = {
    "op1_chat_formatting": OP1_SQL,
    "op4_exact_top_k": OP4_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}

"""Queries of the training-data operators over the synthetic tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, decontaminate, hard_negatives, language_id, line_dedup, minhash_dedup, pii, secret_scan, vector_dedup, warc
from .shared import new_path
from .token_output import token_index
from .token_text import default_tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op2_pruned_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op4_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts are control strings throughout."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.report(turns.unionByName(extra))


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), default_tokenizer())


def op8_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_report(_table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(_table(spark, sf_dir, "documents"), default_tokenizer())


def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.label(docs, model).withColumn("held_out", language_id.held_out())


def op11_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_index(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op13_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_line_dedup, op2_pruned_graph_dedup, op3_pii_boosting, op4_chat_parts, op5_fm_index_decontamination,
    op6_tensored_minhash, op7_bpe_transducer, op8_secret_cnn, op9_token_output, op10_language_bitmask,
    op11_hilbert_negatives, op12_zstd_warc, op13_setm_collocations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


#: Turns by number; the template adds 8 + 11 + 7 marks a turn, and a backslash for each control string.
_OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS x FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(x) + 26) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

_OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.id
"""

_OP5_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), docwin AS (
  SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, k, item_id, docwin.size AS size FROM docwin JOIN win ON docwin.g = win.g AND docwin.size = win.size
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_OP6_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN least ON d.doc_id = least.id
"""

_OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CASE WHEN len(a.q) = 0 THEN 0 ELSE list_inner_product(a.q, b.q)::BIGINT END AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""

#: 40 hex digits of the SHA-1 as eight groups of 20 bits, each four base32 letters.
_OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS origin FROM p GROUP BY html),
h AS (SELECT page_id, origin, octet_length(encode(p.html)) AS size, [('0x' || substr(sha1(p.html), 5 * i + 1, 5))::INT for i in range(0, 8)] AS part FROM p JOIN g ON p.html = g.html)
SELECT page_id, size::BIGINT AS payload_bytes,
       array_to_string(list_transform(flatten([[x >> 15, (x >> 10) & 31, (x >> 5) & 31, x & 31] for x in part]), lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM h
"""

#: Every phrase of 1 to 5 words as a list, counted; products as 128-bit integers.
_OP13_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)
), total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest([w[i : i + k - 1] for i in range(1, len(w) - k + 2)]) AS phrase FROM p, range(1, 6) t(k) WHERE len(w) >= k) GROUP BY ALL
), c AS (SELECT * FROM g WHERE k > 1 AND f >= 100),
part AS (SELECT lang, f, phrase[i : i + m - 1] AS inner_phrase FROM c, range(2, 5) t(m), range(1, 5) u(i) WHERE m < k AND i + m - 1 <= k),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN part ON c.lang = part.lang AND c.phrase = inner_phrase WHERE 100 * part.f >= 100 * c.f),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, n, (1000 * c.f::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score
  FROM c ANTI JOIN dropped d ON c.lang = d.lang AND c.phrase = d.phrase
  JOIN range(1, 5) t(j) ON j < c.k JOIN g l ON l.lang = c.lang AND l.phrase = c.phrase[1 : j] JOIN g r ON r.lang = c.lang AND r.phrase = c.phrase[j + 1 : c.k] JOIN total ON total.lang = c.lang
), worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank, array_to_string(phrase, ' ') AS phrase,
       a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM worst QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_pruned_graph_dedup": _OP2_SQL, "op4_chat_parts": _OP4_SQL, "op5_fm_index_decontamination": _OP5_SQL, "op6_tensored_minhash": _OP6_SQL, "op11_hilbert_negatives": _OP11_SQL, "op12_zstd_warc": _OP12_SQL, "op13_setm_collocations": _OP13_SQL}

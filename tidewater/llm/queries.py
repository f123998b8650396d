"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.byte_bpe import round_trip
from tidewater.llm.common import table, tokenizer_path
from tidewater.llm.exact_dedup import exact_duplicates
from tidewater.llm.line_dedup import line_digests
from tidewater.llm.packing import pack_documents
from tidewater.llm.simhash import near_duplicates
from tidewater.llm.suffix_dedup import repeat_digests
from tidewater.llm.token_counts import count_tokens
from tidewater.llm.toxicity import label_categories, toxicity, train_on
from tidewater.llm.vp_search import nearest
from tidewater.llm.window_dedup import window_digests

#: Bytes as pairs of hexadecimal digits; the digest of a string's digits stands for the string.
OP2_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS pos FROM d
), s AS (
  SELECT doc_id, pos, substring(h, 2 * pos - 1, 2) AS byte, CASE WHEN pos + 199 <= len(h) // 2 THEN md5(substring(h, 2 * pos - 1, 400)) END AS seq FROM w
), c AS (
  SELECT doc_id, pos, byte, seq IS NOT NULL AND count(*) OVER (PARTITION BY seq) > 1 AS again FROM s
), g AS (
  SELECT doc_id, pos, byte, max(again::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 1 AS gone FROM c
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM g
), a AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id
)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

OP6_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), h AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, h.key IS NOT NULL AS dropped FROM k LEFT JOIN h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words FROM documents
), w AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d
), s AS (
  SELECT doc_id, pos, words[pos] AS word, CASE WHEN pos + 34 <= len(words) THEN array_to_string(words[pos:pos + 34], ' ') END AS seq FROM w
), c AS (
  SELECT doc_id, pos, word, seq IS NOT NULL AND count(*) OVER (PARTITION BY seq) > 1 AS again FROM s
), g AS (
  SELECT doc_id, pos, word, max(again::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM c
), a AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"), length=200)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    docs = docs.select("doc_id", "lang", "text")
    return train_on(docs, labels, label_categories(labels, docs))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, toxicity_chain(spark, docs, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, relax=1.25)


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_digests(table(spark, sf_dir, "documents"), length=35)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_counts, op2_suffix_array_dedup, op3_byte_bpe, op4_simhash_near_dedup, op5_exact_dedup, op6_line_dedup, op7_toxicity, op8_nearest_neighbours, op9_window_dedup, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_nearest_neighbours": OP8_SQL, "op9_window_dedup": OP9_SQL}

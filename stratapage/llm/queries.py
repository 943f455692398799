"""Registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapage.llm import bpe, decontaminate, fingerprints, language, licenses, minhash, suffixes, toxicity, urls, warc
from stratapage.llm.common import table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digest(table(spark, sf_dir, "documents"), length=100)


OP4_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5(h[2*i+1 : 2*i+200]) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM texts)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), islands AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later)
), runs AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM islands GROUP BY doc_id, island
), pieces AS (
  SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS low, low AS high FROM runs
  UNION ALL SELECT doc_id, max(high), NULL FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(CASE WHEN high IS NULL THEN h[2*low+1 :] WHEN high > low THEN h[2*low+1 : 2*high] ELSE '' END, '' ORDER BY low, high NULLS LAST) AS k
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
), totals AS (SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages"), later=500))
    merged = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.element_at("headers", k))), ";")
    return found.select(F.col("record_id").alias("page_id"), "canonical_url", F.col("source_id").alias("source_page_id"), "outcome", "source_digest", merged.alias("merged_headers"))


OP2_SQL = r"""
WITH bare AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://', '') AS b FROM pages
), parts AS (
  SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(b, '(?s)^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '(?s)\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS q
  FROM bare
), captures AS (
  SELECT page_id, md5(html) AS digest, length(html) AS size, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM parts
), matched AS (
  SELECT v.page_id, v.url, v.digest, s.page_id AS source, s.digest AS source_digest, s.size,
         row_number() OVER (PARTITION BY v.page_id ORDER BY s.page_id DESC NULLS LAST) AS n
  FROM captures v LEFT JOIN captures s ON s.url = v.url AND s.size > 0 AND s.page_id < v.page_id + 500
)
SELECT page_id, url AS canonical_url, source AS source_page_id,
  CASE WHEN source IS NULL THEN 'unmatched' WHEN digest = source_digest THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN digest = source_digest THEN source_digest END AS source_digest,
  CASE WHEN digest = source_digest THEN 'content-length=' || size || ';date=' || (page_id + 500) || ';etag=W/"' || digest || '";server=origin' END AS merged_headers
FROM matched WHERE n = 1
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.7)


#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def _word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(table(spark, sf_dir, "documents"), _word_vocabulary())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)


OP9_SQL = rf"""
WITH lowered AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, 13 AS n, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS s FROM items WHERE len(w) >= 13
  UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 12
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows v ON g.s = v.s AND g.n = v.n
), covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_document_fingerprints": op10_document_fingerprints,
}
SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op2_warc_revisits": OP2_SQL,
    "op4_suffix_array_dedup": OP4_SQL,
    "op9_decontamination": OP9_SQL,
}

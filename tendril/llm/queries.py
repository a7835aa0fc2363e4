"""The registered queries of the sub-package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tendril.llm.audit import filter_audit
from tendril.llm.exact import exact_dedup
from tendril.llm.fingerprints import compare_with_next
from tendril.llm.langid import identify_documents, identify_pages
from tendril.llm.nearjoin import near_dedup
from tendril.llm.packing import pack_documents
from tendril.llm.pieces import encode_pieces
from tendril.llm.quality import score_quality
from tendril.llm.rules import judge
from tendril.llm.shared import table, tokenizer_path
from tendril.llm.substring import substring_dedup
from tendril.llm.toxicity import score_toxicity
from tendril.llm.urls import judge_urls
from tendril.llm.whitening import whiten

QUERIES: dict = {}
ORACLES: dict = {}


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES["op4_exact_dedup"] = op4_exact_dedup
ORACLES["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS nth,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES["op6_quality_rules"] = op6_quality_rules


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=2)


QUERIES["op5_minhash_near_dedup"] = op5_minhash_near_dedup


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES["op9_best_fit_packing"] = op9_best_fit_packing


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES["op10_url_filters"] = op10_url_filters
ORACLES["op10_url_filters"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT page_id, host, path, '.' || host AS h,
         CASE WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
              WHEN '.' || host LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
              WHEN '.' || host LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
              WHEN '.' || host LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
              WHEN '.' || host LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN h LIKE '%.cheap-pills.example.com' OR h LIKE '%.spam-farm.example.org' THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), tails=True)


QUERIES["op1_substring_dedup"] = op1_substring_dedup


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op2_toxicity"] = op2_toxicity


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"))


QUERIES["op8_language_id"] = op8_language_id
QUERIES["language_id_pages"] = language_id_pages


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op7_quality_classifier"] = op7_quality_classifier


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES["op3_sentencepiece"] = op3_sentencepiece


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op11_filter_interaction_audit"] = op11_filter_interaction_audit
ORACLES["op11_filter_interaction_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), l AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d, (doc_id > least)::INT AS e,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM w LEFT JOIN l USING (doc_id)
), cells AS (
  SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM m GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order FROM f f1, f f2, f f3, f f4, f f5
  WHERE len(list_distinct([f1.x, f2.x, f3.x, f4.x, f5.x])) = 5
), steps AS (
  SELECT filter_order, s::INT AS step, filter_order[s] AS x, filter_order[1:s - 1] AS earlier FROM orders, range(1, 6) AS r(s)
), fails AS (
  SELECT part, n, n_good, n_bad, a + b + c + d + e AS fail_count,
         (CASE WHEN a = 1 THEN 'A' ELSE '' END) || (CASE WHEN b = 1 THEN 'B' ELSE '' END) || (CASE WHEN c = 1 THEN 'C' ELSE '' END)
         || (CASE WHEN d = 1 THEN 'D' ELSE '' END) || (CASE WHEN e = 1 THEN 'E' ELSE '' END) AS failed
  FROM cells
), judged AS (
  SELECT part, filter_order, step, x, n, n_good, n_bad, fail_count, contains(failed, x) AS hit,
         earlier <> '' AND regexp_matches(failed, '[' || CASE WHEN earlier = '' THEN '_' ELSE earlier END || ']') AS gone
  FROM fails, steps
), s AS (
  SELECT part, filter_order, step, x,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (hit AND fail_count = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
         coalesce(sum(n_bad) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM s
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES["op12_embedding_whitening"] = op12_embedding_whitening


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES["op13_document_fingerprints"] = op13_document_fingerprints

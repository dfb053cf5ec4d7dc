"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat_format, cover_tree, katz, ordinal, secret_scan, simhash, suffix_dedup
from sparkloom.llm import curriculum as mixing
from sparkloom.llm import exact_dedup as exact
from sparkloom.llm.common import cut, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = chat_format.schemas_of(spark, {"reply": {"prompt": ("string", True), "turn": ("integer", True)}})
    out = chat_format.chat_messages(table(spark, sf_dir, "conversations"), schemas)
    return out.select("conv_id", "position", "turn", "kind", "role", "call_id", "result_turn", F.array_join("problems", "; ").alias("problems"), F.sha2("json", 256).alias("json_sha256"))


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = cut(secret_scan.dictionary(docs))
    forest = secret_scan.train_forest(secret_scan.featured(secret_scan.synthetic_findings(spark), words))
    out = secret_scan.scan(docs, forest, words, path_col="source")
    return out.select("doc_id", "at", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), "score", "is_secret")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum(table(spark, sf_dir, "documents"), mixing.ranked_schedules)
    first = F.round(F.try_element_at("positions", F.lit(1)), 9)
    out = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return out.orderBy(F.asc_nulls_last("first_position"), "doc_id")


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.classify(docs, ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels"))))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passage_dedup(table(spark, sf_dir, "documents"))


def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_cover_tree": op2_cover_tree,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op8_bpe_chunks": op8_bpe_chunks,
    "op9_katz": op9_katz,
    "op10_simhash": op10_simhash,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op6_secret_forest": op6_secret_forest,
    "op7_exact_dedup": op7_exact_dedup,
}

ORACLE_SQL = {
    "op1_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, 'exchange:' || conv_id || ':' || turn AS call_id, text, CASE WHEN turn >= 2 THEN 'exchange:' || conv_id || ':' || (turn - 2) END AS need
  FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn AS result_turn, 'exchange:' || conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.result_turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id,
         r.result_turn, c.text, r.content, c.call_id IS NOT NULL AS is_call, c.need, p.call_id IS NULL AS no_need, r.call_id IS NULL AS no_result, c.turn AS asked
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN c p ON p.conv_id = c.conv_id AND p.call_id = c.need),
k AS (
  SELECT *, list_concat(list_concat(list_concat(
      CASE WHEN is_call AND no_result THEN ['no result'] ELSE []::VARCHAR[] END, CASE WHEN NOT is_call THEN ['no call'] ELSE []::VARCHAR[] END),
      CASE WHEN need IS NOT NULL AND no_need THEN ['needs unknown ' || need] ELSE []::VARCHAR[] END),
      CASE WHEN is_call AND text IS NULL THEN ['missing prompt'] ELSE []::VARCHAR[] END) AS problems
  FROM j),
every AS (
  SELECT conv_id, turn, CASE WHEN is_call THEN 'call' ELSE 'result' END AS kind, NULL AS role, call_id, result_turn, array_to_string(problems, '; ') AS problems,
         json_object('arguments', CASE WHEN is_call THEN json_object('prompt', text, 'turn', asked) END, 'call_id', call_id, 'content', content,
                     'name', CASE WHEN is_call THEN 'reply' END, 'problems', problems)::VARCHAR AS json
  FROM k
  UNION ALL
  SELECT conv_id, turn, 'message', role, NULL, NULL, '', json_object('content', text, 'role', role)::VARCHAR
  FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, call_id NULLS LAST, json)::INT AS position, turn, kind, role, call_id, result_turn, problems,
       sha256(json) AS json_sha256
FROM every""",
    "op2_cover_tree": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.9::DOUBLE * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
    AND list_dot_product(a.e, a.e) > 0 AND list_dot_product(b.e, b.e) > 0),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT low.a AS vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, component_id, low.a = component_id AS kept
FROM low LEFT JOIN deg ON low.a = deg.a""",
    "op4_curriculum_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
totals AS (SELECT source, sum(size)::DOUBLE AS s FROM d GROUP BY source),
weighed AS (
  SELECT source, s, 3.0 * s AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM totals),
filled AS (
  SELECT *, cap / w AS ratio, sum(s) OVER () AS every,
         sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS before,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
  FROM weighed),
leveled AS (SELECT *, (every - before) / remaining AS lvl, (every - before) / remaining >= ratio AS is_full FROM filled),
targets AS (
  SELECT source, s, w, CASE WHEN is_full THEN cap ELSE w * max(CASE WHEN NOT is_full THEN lvl END) OVER () END AS target
  FROM leveled),
placed AS (
  SELECT d.doc_id, d.size, t.s, t.w, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size + d.size / 2.0::DOUBLE AS mid
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, (CASE WHEN mid < target THEN 1 ELSE 0 END + CASE WHEN s + mid < target THEN 1 ELSE 0 END + CASE WHEN 2 * s + mid < target THEN 1 ELSE 0 END) AS copies,
         mid * w / target AS area,
         CASE w WHEN 5.0 THEN 2.5::DOUBLE WHEN 2.0 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS w0,
         CASE w WHEN 5.0 THEN 5.0::DOUBLE WHEN 2.0 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS slope
  FROM placed)
SELECT doc_id, size, s::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(least(2.0 * area / (w0 + sqrt(greatest(w0 * w0 + 2.0 * slope * area, 0.0))), 1.0), 9) END AS first_position
FROM copied""",
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS chars
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
}

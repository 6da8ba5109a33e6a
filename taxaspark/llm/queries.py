"""Thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, katz, mixing, near_dedup, substring_dedup
from .chat_format import formatted_digests, illustrated, part_digests, probe_conversation
from .exact_dedup import DigestIndex
from .license_scan import scan_licenses
from .toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    found = index.add(_table(spark, sf_dir, "documents"))
    index.drop()  # the query's own; a lasting one has a name
    return found


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return formatted_digests(rows.unionByName(probe_conversation(spark)))


def q_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatter over parts of all kinds: each turn's text and an attachment."""
    return part_digests(illustrated(_table(spark, sf_dir, "conversations")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op10_substring_dedup": op10_substring_dedup,
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_html_extract": op3_html_extract,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixing": op5_mixing,
    "op6_katz_score": op6_katz_score,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat_format": op9_chat_format,
    "q_chat_parts": q_chat_parts,
}

ORACLES = {
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
        e AS (
            SELECT *, length('<turn:>') + length(role) + length(text) + length('</turn>') + 1
                      + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))
                      + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', ''))
                      + length(role) - length(replace(role, '>', '')) AS n
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "q_chat_parts": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(turn, 0) AS t,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
            FROM conversations),
        e AS (
            SELECT *, replace(replace(text, '', '\s'), '<', '\l') AS said, replace(replace(replace(role, '', '\s'), '<', '\l'), '>', '\g') AS who,
                   CASE t % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'document' ELSE 'video' END AS kind,
                   (t + 1) * CASE t % 4 WHEN 1 THEN 25 WHEN 2 THEN 700 ELSE 1 END AS tokens
            FROM c)
        SELECT conv_id,
               sha256(string_agg('<turn:' || who || '>' || said || '<' || CASE kind WHEN 'video' THEN 'part:video' ELSE kind END || '></turn>' || chr(10), '' ORDER BY k)) AS formatted_sha256,
               count(*) AS n_attachments, CAST(sum(tokens) AS BIGINT) AS expanded_tokens,
               sha256(string_agg(concat_ws(' ', turn, 0, kind, 'store/' || conv_id, tokens), chr(10) ORDER BY k)) AS attachments_sha256
        FROM e GROUP BY conv_id""",
}

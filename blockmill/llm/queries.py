"""Queries over this subpackage's operators: one for each, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, quality_mil, warc
from .common import Scratch, table
from .decontaminate import find_leaks, passage_items
from .jaccard_join import jaccard_components
from .lm_score import score_documents
from .mixing import mix, mix_oracle
from .pii import pii_report
from .quality_rules import repetition_rules
from .secret_scan import scan_secrets

#: Characters of a block of the mix.
BLOCK_CHARS = 100_000


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=80)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), block_chars=BLOCK_CHARS)


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("dup_ngram_share", "reason")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more that says the template's own control strings."""
    said = r"\### Assistant: </turn> ok".replace("\\", "\\\\")
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_conversations(rows))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("credentials")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by passage; and, as rows without `matched` and doc_id, the items of each passage that several hold."""
    bench = table(spark, sf_dir, "benchmark")
    return find_leaks(table(spark, sf_dir, "documents"), bench).unionByName(passage_items(bench), allowMissingColumns=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc"), least_bytes=0)
    return warc.pages_from_archives(warc.read_archives(archives, payloads=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_mix_sources": op3_mix_sources,
    "op4_repetition_rules": op4_repetition_rules,
    "op5_chat_format": op5_chat_format,
    "op6_pii": op6_pii,
    "op7_quality_mil": op7_quality_mil,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
}
ORACLES: dict[str, str] = {
    "op3_mix_sources": mix_oracle(BLOCK_CHARS),
    "op5_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), ':', '\c') AS r,
    replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h') AS t FROM rows
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    CAST(sum(length('### ' || r || ': ' || t || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
""",
}

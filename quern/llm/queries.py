"""Queries of this subpackage, one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, chat, decontaminate, embedding, filteraudit, lm, minhash, piece, quarantine, sstable, toxicity, urlfilter, warc
from quern.scratch import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the model, and under the unigram base."""
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones outside the held-out fold."""
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back from the output."""
    return chat.digests(chat.format_conversations(chat.with_extra(_table(spark, sf_dir, "conversations"))))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written to sorted shards, read back from the files."""
    folder = scratch_path(spark, "shards")
    manifest = sstable.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return sstable.read(spark, folder, manifest)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, read back from the archives."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order of five filters keeps, removes and loses in every source."""
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a SentencePiece vocabulary."""
    return piece.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, deliveries and releases of every turn of all conversations."""
    return quarantine.replay(_table(spark, sf_dir, "conversations"))


WARC_ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


EMBEDDING_ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9
), r AS (
  SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id
), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_minhash_dedup, op2_lm_score, op3_toxicity, op4_bpe, op5_chat_format, op6_token_shards, op7_decontaminate, op8_embedding_dedup, op9_warc, op10_url_filter, op11_filter_audit, op12_sentencepiece, op13_quarantine)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.ORACLE, "op8_embedding_dedup": EMBEDDING_ORACLE, "op9_warc": WARC_ORACLE, "op11_filter_audit": filteraudit.ORACLE, "op13_quarantine": quarantine.ORACLE}

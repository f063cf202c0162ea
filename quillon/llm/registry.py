"""The registered queries of the operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer(name: str) -> str:
    """Where a vocabulary file is on this machine; the workers have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, secret_spans

    return digest(secret_spans(table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"), 3, 90).drop("root", "body")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import report

    return report(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("url")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import media_digests

    return media_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, personal_spans

    return digest(personal_spans(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import base_failed, quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    m = F.col("__m")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality(docs, ["doc_id", "lang", "source"]).select("doc_id", *[m[k].alias(k) for k in counts], base_failed(m).alias("base_failed"), F.col("__kept").alias("kept"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op12_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .max_score import nearest

    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_report

    return repair_report(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_sentencepiece, op3_jaccard, op4_mixing, op5_toxicity, op6_warc, op7_matroska, op8_pii, op9_quality, op10_token_counts, op11_filter_audit, op12_max_score, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    from . import conversations, filter_audit, max_score, warc

    return {"op6_warc": warc.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL, "op12_max_score": max_score.ORACLE_SQL, "op13_conversation_repair": conversations.ORACLE_SQL}

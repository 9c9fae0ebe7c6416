"""The thin queries of this subpackage: operator N over its whole table, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, language, minhash, mixing, quality_prior, quality_rules, toxicity, warc, winnow


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.tune(spark)
    return common.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    _, directory = warc.archive(pages)
    return warc.fetch(pages, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.identify(docs.select("doc_id", "text"), *model).select("_doc.doc_id", language.held_out(F.col("_doc.doc_id")).alias("held_out"), "lang_pred", "score")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_read(spark, sf_dir, x) for x in ("documents", "labels"))
    known = labels.select("doc_id", "toxic").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.learn(docs.select("doc_id", "text").filter(~toxicity.held_out(F.col("doc_id"))), known)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_quality_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for its host, and its language within the source for its path."""
    docs, labels = (_read(spark, sf_dir, x) for x in ("documents", "labels"))
    known = labels.select("doc_id", "quality").filter(~toxicity.held_out(F.col("doc_id")))
    model = quality_prior.learn(docs.select("doc_id", "text").filter(~toxicity.held_out(F.col("doc_id"))), known)
    return quality_prior.score(docs.select("doc_id", "text", "source", "lang"), model, F.col("source"), F.col("lang"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).selectExpr("_doc.doc_id AS doc_id", "size", "source_size", "target", "size * copies AS taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).drop("clean_text").selectExpr("_doc.doc_id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_language_id, op3_minhash, op4_winnowing, op5_toxicity, op6_quality_prior, op7_mixing, op8_quality_rules, op9_chat_quotes, op10_bpe)}

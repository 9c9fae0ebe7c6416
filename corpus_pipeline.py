"""The corpus pipeline: language ID, quality rules, near-duplicate removal, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as the next
stage's docs. All but the last return the columns of docs, whatever they are. Documents leave at language ID (no
letter, or no language likelier than the rest), at the quality rules, and as near copies of a kept document; mixing then
repeats or leaves out whole documents to meet its targets; the last stage codes the text.

Defined results: a null text has no letter and leaves at the first stage; an empty table passes through every stage as
one; each stage's docstring states the rest. Columns other than doc_id, text, lang, source and n_chars, whatever their names, pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, common, language, minhash, mixing, quality_rules

#: The softmax share below which no language stands out.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the labelled documents, keeps the documents that have one, and puts it into lang.

    Without a labelled text nothing is learned and nothing kept. Null, empty and letterless texts leave; a very long text is
    profiled whole; of equally near languages the first by name counts, at a score that leaves; repeated rows are judged alike.
    """
    common.tune(spark)
    model = language.learn(docs)
    found = language.identify(docs, *model).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return found.select(*[F.col("lang_pred" if c == "lang" else f"_doc.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines and drops documents that fail the rules or lose too much; n_chars follows the text.

    Null and empty texts fail; very long texts are judged whole; repeated rows are judged alike.
    """
    common.tune(spark)
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that with the smallest doc_id; of rows that repeat it, one.

    Rows with a null doc_id stay, as do texts without a word, each by itself; very long texts are compared whole.
    """
    common.tune(spark)
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to their source's target weight, by the sizes of what is left.

    A null source is one of its own; texts without a word have size 0; repeated rows draw alike; a very long document is taken whole or not.
    """
    common.tune(spark)
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Codes the text: (doc_id, n_tokens, ids_sha256, decoded_sha256). Null and empty texts have no token; very long ones are coded whole; repeated rows repeat."""
    common.tune(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("quality_rules", quality), ("minhash_dedup", near_dedup), ("mixing", mix), ("bpe", tokenize)]

#: The models and signatures of three stages are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.table(stage(spark, common.spread(docs), sf_dir), f"stage-{name}")
    return docs

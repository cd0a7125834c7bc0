"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Defined results: nulls, empty texts, texts of any length and repeated rows are handled as the stages' operators say; further columns
stay as they are, whatever their names; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, quality, secrets, simhash
from tidemark.llm.common import table, text_of, word_count, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    measured = written(quality.measure(docs), "measured")
    return quality.judged(measured, quality.Rules()).filter("__kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, a Jaccard similarity of 0.8 or more.

    The one with the smallest id stays, as it is. Equal texts are one document, whatever their ids, and the least of its rows stays; rows that
    share an id but not a text are judged apart; a null id stays only where its class has no other. Texts of any length are compared whole.
    """
    found = simhash.near_texts(docs)
    at = lambda key, own: F.struct(key.alias("key"), own.alias("id"))
    stays = found.filter("key = class_key").select(at(F.col("key"), F.col("id")).alias("__at"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    # the join deals and sorts texts by text and id, and the aggregation reuses both; as fields of a struct, null ids are equal
    kept = docs.select(at(simhash.key_of(), F.col("doc_id")).alias("__own"), row).join(stays, F.col("__own") == F.col("__at"))
    return kept.groupBy("__at").agg(F.min("__row").alias("__row")).select("__row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted again."""
    found = secrets.scan(docs)
    clean = found.withColumn("text", F.when(F.size("__spans") > 0, secrets.redacted(text_of("text"), F.col("__spans"))).otherwise(F.col("text")))
    n = F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed = mixing.mix(docs, word_count(text_of("text")), F.array("source"))
    return mixed.select(*docs.columns, F.explode("__copies").alias("__copy")).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and decoded text."""
    return bpe.encode_texts(docs.select("doc_id", "source", "text"), bpe.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_tokens),
]
#: Fingerprints, components and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

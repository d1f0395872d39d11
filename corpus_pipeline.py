"""From raw documents to tokens: each stage is written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) with ``docs`` a table read from files, and returns a DataFrame; all but the
last return the columns of ``docs``. Null and empty texts don't pass the first stage, for they have
no letter; an empty table passes through all stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.llm import decontaminate, langid, piece_bpe, simhash, suffix_dedup
from passageworks.llm.base import stored

PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: The stages learn and count; SQL doesn't express the first, second, third and last.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The models learn from the labels of ``docs`` itself."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    told = langid.identify(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")), model)
    return told.where(~F.col("rejected")).select("_all.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that appear earlier in the corpus."""
    return suffix_dedup.drop_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the text they decode to."""
    told = piece_bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), PIECES, decoded=False)
    return told.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontaminated", decontaminated), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

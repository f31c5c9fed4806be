"""A corpus in five stages: language, quality, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and read again before the next. All but the last return the columns of ``documents``, further ones
included, whose names can't clash with anything. Empty tables give empty tables; very long texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import byte_bpe, language_id, mixing, ordinal_quality, shingle_dedup
from linkloom.scratch import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told, null, empty and letterless texts among them; repeated rows alike."""
    return language_id.keep_identified(docs)


def grade_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal model doesn't put in the top grade; it learns from ``labels``. Without ratings all stay; with them wordless texts go."""
    return ordinal_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group that pairs of five-word Jaccard similarity 0.8 or more join, of equal ids one row; rows without an id stay."""
    return shingle_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out, keeps or doubles documents, so that the sources come to their targets. Wordless texts are never taken; a null source is one."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """The packed ids of each text, with their number and the digests of ids and decoded bytes; a null text has none."""
    vocabulary = byte_bpe.load_vocabulary(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), vocabulary, decoded="decoded")
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", grade_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", tokenize),
]

#: SQL can't express the trained models, the fingerprints or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

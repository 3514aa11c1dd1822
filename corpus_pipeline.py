"""A corpus from raw documents to packed training sequences, in five stages.

Each stage gets all that the one before it kept, written as Parquet and read again. Python
workers outlive a stage, so every stage shortens the batches that they get; as its result is
lazy, that holds for the session (``run`` puts the setting back).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import jaccard, langid, mixing, packing, toxicity
from folioflow.llm._work import materialise, short_batches, shorten_batches, temporary

#: Training and packing have no SQL; tests run the chain on small tables and compare each stage with what it got.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go, such as random letters and encoded data.

    So do null and empty texts; those in doubt stay. Repeated rows stay or go alike, columns stay as they are, an
    empty table stays empty, and a corpus without any lang loses all documents.
    """
    shorten_batches(spark)
    return langid.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go.

    Null and empty texts stay, as a text without words is not toxic; so does all if there
    are no labels. Repeated rows stay or go alike; an empty table stays empty.
    """
    shorten_batches(spark)
    return toxicity.keep_harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    It is the one of the smallest doc_id. Rows without a doc_id and documents without words
    all stay; of rows of one doc_id one stays; an empty table stays empty.
    """
    shorten_batches(spark)
    return jaccard.keep_one_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; some documents are repeated, cut or left out.

    A null source is one of its own; empty texts are left out; an empty table stays empty.
    """
    shorten_batches(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens.

    Null and empty texts are an end token alone; repeated rows are packed one by one; an
    empty table gives no pieces.
    """
    shorten_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is written on the way is removed, but for the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (last, stage) = STAGES
    with temporary(spark), short_batches(spark):
        for name, function in before:
            with temporary(spark):
                docs = materialise(function(spark, docs, sf_dir), f"stage-{name}", keep=True)
        return materialise(stage(spark, docs, sf_dir), f"stage-{last}", keep=True)

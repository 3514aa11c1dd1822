"""The registered queries of the ``llm`` operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import elkan, idfiles, jaccard, langid, licenses, mixing, packing, scoring, topk, toxicity, trie, vector_dedup, warc
from ._work import materialise, temporary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):  # the archives go when their records have been read
        found = warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        return materialise(found, "records", keep=True)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):
        return materialise(elkan.compress(_table(spark, sf_dir, "embeddings")), "coded", keep=True)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):
        return materialise(trie.prefix_trie(_table(spark, sf_dir, "conversations")), "trie", keep=True)


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):  # the files go when their documents have been read
        return materialise(idfiles.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "id-documents", keep=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_nnls_packing": op2_nnls_packing,
    "op3_kd_tree_search": op3_kd_tree_search,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_warc": op8_warc,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_elkan_codes": op11_elkan_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_id_files": op13_id_files,
}

ORACLES: dict[str, str] = {
    "op3_kd_tree_search": topk.ORACLE,
    "op6_vector_dedup": vector_dedup.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op11_elkan_codes": elkan.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
}

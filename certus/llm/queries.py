"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from certus.llm.ann import nearest_neighbours
from certus.llm.common import scratch, table
from certus.llm.langid import predict_language
from certus.llm.licenses import scan_licenses
from certus.llm.lm_score import score_documents
from certus.llm.packing import pack
from certus.llm.pieces import piece_digests
from certus.llm.simhash import simhash_groups
from certus.llm.suffix_dedup import repeated_spans
from certus.llm.vector_dedup import near_duplicate_vectors
from certus.llm.warc import read_archives, write_archives


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_ann": op2_ann,
        "op3_warc": op3_warc,
        "op4_pack": op4_pack,
        "op5_vector_dedup": op5_vector_dedup,
        "op6_langid": op6_langid,
        "op7_licenses": op7_licenses,
        "op8_lm_score": op8_lm_score,
        "op9_pieces": op9_pieces,
        "op10_simhash": op10_simhash,
    }

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.functions.storage import saved, shared_dir

__all__ = ["CHUNK_BYTES", "chunk_count", "in_chunks", "parts", "saved", "scratch", "shared_dir", "table"]

#: Text bytes in one chunk of documents; a chunk is handled by one task at a time.
CHUNK_BYTES = 8 << 20


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_count(docs: DataFrame, text: str = "text") -> int:
    """How many chunks of about CHUNK_BYTES the texts fill."""
    n = docs.agg(F.sum(F.octet_length(F.col(text)) + 16)).first()[0] or 0
    return max(1, -(-int(n) // CHUNK_BYTES))


def in_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, text (null: empty) and the chunk that a hash of both deals them to, so that no id fills a chunk."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    )

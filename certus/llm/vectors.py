"""Which rows of an embedding table count as vectors, and their packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """The rows whose embedding is finite, not all zero and of the usual length.

    The usual length is the one that most such rows have (ties: the larger).
    Rows with a null vec_id are left out.
    """
    finite = "vec_id is not null and embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.where(finite)
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column, all lists of one length, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)

"""Block sizes kept up to date over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violating_keys(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Keys of which different rows have come; rows that repeat within the delay count once.

    An update-mode query: each key is reported anew whenever its number grows.
    """
    rows = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(stream.columns)
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")

"""Blocks: the rows of a table that agree on its declared key.

Equal rows count once. Null key values agree with each other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certus.plans.query import OWN, Atom, Table

#: The column with the number of rows of a row's block.
SIZE = f"{OWN}size"

#: Rows that one task is given on average, where a table has more than that.
ROWS = 400_000


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """A frame of about so many rows, dealt by some columns to tasks whose number grows with the rows.

    The memory of a task then stays the same, whatever the number of shuffle
    partitions is. Small frames are left as they are.
    """
    if rows <= ROWS:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(-(-rows // (ROWS * cores)) * cores, *columns)


def distinct_rows(table: Table, columns: list[str] | None = None) -> DataFrame:
    """Different rows over the key and some columns, dealt by key: one shuffle serves all that follows."""
    columns = [*table.key, *(c for c in columns or table.frame.columns if c not in table.key)]
    rows = table.frame.select(columns)
    rows = dealt(rows, table.rows, *table.key) if table.rows > ROWS else rows.repartition(*table.key)
    return rows.dropDuplicates()


def block_sizes(table: Table) -> DataFrame:
    """Key and number of different rows, n_rows."""
    return distinct_rows(table).groupBy(*table.key).agg(F.count("*").alias("n_rows"))


def violating_keys(table: Table) -> DataFrame:
    return block_sizes(table).where("n_rows > 1")


def histogram(table: Table) -> DataFrame:
    """block_size, n_blocks."""
    return block_sizes(table).groupBy(F.col("n_rows").alias("block_size")).agg(F.count("*").alias("n_blocks"))


def with_size(table: Table, columns: list[str] | None = None) -> DataFrame:
    """Different rows and their block's number of rows over the same columns, SIZE."""
    return distinct_rows(table, columns).withColumn(SIZE, F.count("*").over(Window.partitionBy(*table.key)))


def clean_part(table: Table) -> DataFrame:
    return with_size(table).where(f"{SIZE} = 1").drop(SIZE)


def dirty_part(table: Table) -> DataFrame:
    return with_size(table).where(f"{SIZE} > 1").drop(SIZE)


def used_columns(table: Table, a: Atom) -> list[str]:
    """Columns that an atom binds or its condition names, whatever the case; perhaps some more, which does no harm."""
    where = re.sub(r"'(?:[^']|\\.|'')*'", " ", a.where).lower()
    named = {c.lower() for c, _ in a.binds} | set(re.findall(r"\w+", where))
    return [c for c in table.frame.columns if c.lower() in named or (not re.fullmatch(r"\w+", c) and c.lower() in where)]

"""Synthetic relations with a known share of inconsistency, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.plans.query import Database, Query


def block_count(rows: int, percent: int = 10, group: int = 2) -> int:
    """How many different keys generated() gives to that many rows."""
    dirty = rows * percent // 100 // group * group
    return rows - dirty + dirty // group


def generated(spark: SparkSession, rows: int, targets: int, percent: int = 10, group: int = 2, joined: int = 25, seed: int = 0) -> DataFrame:
    """key, ref, value: ``percent`` of the rows are in blocks of ``group`` rows, the others alone in theirs.

    ``joined`` percent of the rows refer to one of the keys 0 to targets - 1,
    the others to none. value is alphanumeric and different in each row.
    """
    dirty = rows * percent // 100 // group * group
    clean, i = rows - dirty, F.col("id")
    key = F.when(i < clean, i).otherwise(F.lit(clean) + F.floor((i - clean) / group)).cast("long")
    hit = F.pmod((i + seed) * 7919, F.lit(100)) < joined
    ref = F.when(hit, F.pmod((i + seed) * 104729, F.lit(max(1, targets)))).otherwise(i + targets)
    return spark.range(rows).select(key.alias("key"), ref.cast("long").alias("ref"), F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), i.cast("string"))), 1, 16).alias("value"))


def chain(spark: SparkSession, relations: int, rows: int, percent: int = 10, group: int = 2, joined: int = 25) -> Database:
    """Relations r1, r2, ... with key ``key``, each referring to the next by ``ref``."""
    db, targets = Database(), block_count(rows, percent, group)
    for k in range(1, relations + 1):
        db.register(f"r{k}", generated(spark, rows, targets, percent, group, joined, k), ["key"])
    return db


def for_query(spark: SparkSession, q: Query, keys: dict[str, list[str]], rows: int, joined: int = 50, dirty: int = 10, sizes: tuple[int, ...] = (2,), seed: int = 0) -> Database:
    """A database for a query whose atoms name different tables: their columns are those that the atoms bind.

    Row i of each table holds, in ``joined`` percent of the cases, values that
    only depend on i and the variable, so that those rows join; the others
    join with nothing. ``dirty`` percent of the keys get further rows with
    values of their own, up to block sizes that are taken in turn from
    ``sizes``. Conditions of the atoms are ignored.
    """
    if len({a.table for a in q.atoms}) < len(q.atoms):
        raise ValueError("each atom needs a table of its own")
    db, i = Database(), F.col("id")
    hit, size = F.pmod((i + seed) * 7919, F.lit(100)) < joined, F.element_at(F.array(*map(F.lit, sizes)), (F.pmod(i, F.lit(len(sizes))) + 1).cast("int"))
    copies = F.when(F.pmod(F.floor(i / len(sizes)), F.lit(100)) < dirty, size - 1).otherwise(0)
    for a in q.atoms:
        columns = []
        for c, v in dict(a.binds).items():
            first = F.when(hit, F.concat_ws("-", F.lit(v), i)).otherwise(F.concat_ws("-", F.lit(v), F.lit(a.table), i))
            text = first if c in keys[a.table] else F.when(F.col("copy") == 0, first).otherwise(F.concat_ws("-", F.lit(v), F.lit(a.table), i, F.col("copy")))
            columns.append(F.substring(F.md5(F.concat_ws("-", F.lit(seed), text)), 1, 16).alias(c))
        made = spark.range(rows).withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int"))))
        db.register(a.table, made.select(*columns), keys[a.table])
    return db

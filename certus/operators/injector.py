"""Deterministic inconsistency: rows that repeat the keys of others.

``percent`` of the rows get into blocks of 2 to 7 rows, the same number of
blocks of each size. Which ones is decided by the rank of the md5 of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZES = range(2, 8)


def ranked(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows with rank (from 0) by md5 of the key, without a sort of all in one place.

    Rows are dealt by the digest's first digits; each part is ranked on its
    own and starts where those before it end.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    rows = df.withColumn("digest", digest).withColumn("part", F.substring("digest", 1, 3))
    sizes = rows.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 parts at most
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("digest", *key))
    return rows.withColumn("own", own).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("own") - 1).drop("digest", "part", "own", "start")


def injected(df: DataFrame, key: list[str], percent: int = 10) -> DataFrame:
    """df and rows that violate its key: the keys of some rows with the other columns of donors."""
    rows = ranked(df, key)
    total = df.count()
    blocks = percent * total // (2700 - 21 * percent)
    if not blocks:
        return df
    targets = rows.where(F.col("rank") < len(SIZES) * blocks).select(*key, F.col("rank").alias("at"))
    size = F.floor(F.col("at") / blocks).cast("long")  # 0 for blocks of two
    # copies of targets of smaller sizes come first: (1 + 2 + ... + size) * blocks of them
    donor = len(SIZES) * blocks + (size * (size + 1) / 2).cast("long") * blocks + (F.col("at") - size * blocks) * (size + 1)
    copies = targets.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), size))).withColumn("donor", donor + F.col("copy")).select(*key, "donor")
    given = copies.join(rows.drop(*key), F.col("donor") == F.col("rank")).select(*df.columns)
    return df.unionAll(given)

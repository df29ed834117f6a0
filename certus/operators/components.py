"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.functions.storage import saved
from certus.operators.blocks import dealt


def connected_components(links: DataFrame, rows: int = 0) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has a link; links: a, b, about so many rows.

    Large-star and small-star steps alternate until the stars stand still.
    Each is a minimum by node and a join with it; no component is gathered.
    Links are dealt to tasks by their number, which each step counts.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = saved(dealt(e, rows, "u", "v").distinct())
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        n = now[0]
        both = dealt(e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n, "u")
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = dealt(large, n, "u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = saved(dealt(small.unionAll(low.select("u", F.col("low").alias("v"))), n, "u", "v").distinct())

"""Ranges of aggregates over all repairs: [lowest, highest] of COUNT, SUM, MIN and MAX.

For a tree of atoms the blocks of the root are independent of each other as
far as bounds go, so each bound is an aggregate of per-block bounds. With
children that rule needs values that aren't negative. Everything else, cyclic
and self-joining queries, several trees, values below zero over a join, goes
to the search over components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.operators.blocks import used_columns
from certus.operators.certain import FULL, HIGH, LOW, WHOLE, covered
from certus.operators.search import all_ranges
from certus.plans.analyze import trees
from certus.plans.query import Atom, Database, Query

NAMES = ["count_glb", "count_lub", "sum_glb", "sum_lub", "min_glb", "min_lub", "max_glb", "max_lub"]


class UnsupportedAggregate(ValueError):
    """AVG and aggregates of DISTINCT values aren't sums over components, so they have no ranges here."""


def has_negative(db: Database, a: Atom, value: str) -> bool:
    """Whether a row of an atom that meets its condition binds a value below zero: one scan of two or three columns."""
    table = db.tables[a.table]
    column = next(c for c, v in a.binds if v == value)
    rows = table.frame.select(*used_columns(table, a)).where(F.expr(a.where))
    return bool(rows.agg((F.min(column) < 0).alias("negative")).first()[0])


def by_tree(db: Database, q: Query, value: str) -> DataFrame:
    b = covered(db, q, value)
    zero = F.when(~F.col(WHOLE), F.lit(0))
    none = F.when(~F.col(FULL), F.lit(0))
    sums = [
        F.sum(F.col(WHOLE).cast("long")).alias("count_glb"),
        F.count("*").alias("count_lub"),
        F.sum(F.coalesce(F.least(LOW, zero), F.lit(0))).alias("sum_glb"),
        F.sum(F.coalesce(F.greatest(HIGH, none), F.lit(0))).alias("sum_lub"),
        F.min(LOW).alias("min_glb"),
        F.min(F.when(F.col(WHOLE), F.col(HIGH))).alias("min_lub"),
        F.max(F.when(F.col(WHOLE), F.col(LOW))).alias("max_glb"),
        F.max(HIGH).alias("max_lub"),
    ]
    return (b.groupBy(*q.free) if q.free else b).agg(*sums).where("count_glb > 0")


def ranges(db: Database, q: Query, value: str, function: str | None = None) -> DataFrame:
    """One row per certain group (the free variables; none: one row with cons_answer).

    count_glb, count_lub, sum_glb, ..., max_lub of the variable ``value``, or
    the two of one function: count, sum, min or max. Groups that some repair
    lacks have no range; without groups the bounds are then null. Nulls add
    nothing to SUM, MIN and MAX. Free variables may not be named like results.
    """
    if function is not None and function.lower() not in ("count", "sum", "min", "max"):
        raise UnsupportedAggregate(function)
    if taken := {v.lower() for v in q.free} & {*NAMES, "cons_answer"}:
        raise ValueError(f"free variables named like results: {sorted(taken)}")
    if all(value not in a.variables for a in q.atoms):
        raise ValueError(f"no atom binds {value}")
    found = trees(db, q, value)
    one = found is not None and len(found) == 1 and value in q.atoms[found[0][0]].variables
    if one and (len(q.atoms) == 1 or not has_negative(db, q.atoms[found[0][0]], value)):
        out = by_tree(db, q, value)
    else:
        out = all_ranges(db, q, value)
    names = [n for n in NAMES if function is None or n.startswith(function.lower())]
    if q.free:
        return out.select(*q.free, *names)
    sure = F.coalesce(F.count("count_glb") > 0, F.lit(False))
    return out.agg(sure.alias("cons_answer"), *[F.first(n).alias(n) for n in names])

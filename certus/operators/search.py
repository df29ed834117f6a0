"""Certain answers and ranges where no rewriting applies.

Witnesses of an answer that share a dirty block hang together; blocks that
don't are picked independently. Blocks that occur alone in their witnesses are
decided by aggregates. What remains is gathered by answer where an answer has
few witnesses, and by component, found with joins, where it has many; each
group is solved by elimination.py, which has no limit on what it can decide.
An answer is certain if some component can't be broken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certus.functions.storage import saved, stored
from certus.operators.blocks import dealt
from certus.operators.certain import DIRTY, boolean, name, own, witnesses
from certus.operators.components import connected_components
from certus.operators.elimination import SUM, TOP, breakable, least
from certus.plans.query import OWN, Database, Query

#: Witnesses that one Python task is given, on average, and how many tasks are enough to give each some more.
TASK, TASKS = 4000, 2000
#: Answers with many witnesses up to which every task gets the list of them.
LISTED = 100_000
#: Rows in the witnesses of an answer up to which they are gathered without looking for components.
FEW = 1000
ANSWER, VALUE, BLOCK, FACT, SIZE, PART = (f"{OWN}{x}" for x in ("answer", "value", "block", "fact", "size", "part"))
PAIR = "struct<a:bigint,b:bigint>"


def _named(ws: DataFrame, free: tuple[str, ...]) -> DataFrame:
    return ws.withColumn(ANSWER, name(*[F.col(v) for v in free] or [F.lit(1)]))


def alone_in(found: DataFrame) -> DataFrame:
    """Of witnesses with at most one dirty block, BLOCK, FACT and SIZE of it."""
    d = F.get(F.col(DIRTY), F.lit(0))
    return found.withColumns({BLOCK: d["block"], FACT: d["fact"], SIZE: d["n"]})


def parted(found: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of witnesses with dirty blocks: those of one block that no larger one of the answer touches, and the others."""
    one = F.size(DIRTY) == 1
    touched = found.where(~one).select(ANSWER, F.explode(DIRTY).alias("d")).select(ANSWER, F.col("d.block").alias(BLOCK))
    touched = dealt(touched, rows, ANSWER, BLOCK).distinct().withColumn("touched", F.lit(True))
    single = dealt(alone_in(found.where(one)), rows, ANSWER, BLOCK).join(touched, [ANSWER, BLOCK], "left")
    alone = single.where("touched is null").drop("touched")
    rest = found.where(~one).unionByName(single.where("touched").drop(BLOCK, FACT, SIZE, "touched"))
    return alone, rest


def gathered(rest: DataFrame) -> DataFrame:
    """A row per group of witnesses that are decided together: ANSWER and the list of (dirty, value)."""
    rest = saved(rest.select(ANSWER, DIRTY, VALUE))
    n = rest.count()
    many = saved(dealt(rest.select(ANSWER, F.size(DIRTY).alias(SIZE)), n, ANSWER).groupBy(ANSWER).agg(F.sum(SIZE).alias(SIZE)).where(F.col(SIZE) > FEW).select(ANSWER))
    hot = many.count()
    small = rest.withColumn(PART, F.lit(None).cast(PAIR))
    if hot:
        listed = lambda df: (df, F.broadcast(many)) if hot <= LISTED else (dealt(df, n, ANSWER), dealt(many, n, ANSWER))
        node = lambda d: name(F.col(ANSWER)["a"], F.col(ANSWER)["b"], d["block"]["a"], d["block"]["b"])
        left, right = listed(rest)
        big = left.join(right, ANSWER, "left_semi").withColumn("node", node(F.col(DIRTY)[0]))
        links = big.select(F.col("node").alias("a"), ANSWER, F.explode(DIRTY).alias("d")).select("a", node(F.col("d")).alias("b"))
        roots = connected_components(links, n).withColumnRenamed("root", PART)
        big = dealt(big, n, "node").join(dealt(roots, n, "node"), "node", "left")
        left, right = listed(small)
        small = left.join(right, ANSWER, "left_anti").unionByName(big.withColumn(PART, F.coalesce(PART, "node")).drop("node"))
    # searching costs more than the size of the rows tells
    tasks = max(1, min(n // TASK, max(TASKS, n // (10 * TASK))))
    return small.repartition(tasks, ANSWER, PART).groupBy(ANSWER, PART).agg(F.collect_list(F.struct(F.col(DIRTY).alias("dirty"), F.col(VALUE).alias("value"))).alias("ws")).select(ANSWER, "ws")


def _groups(b: pa.RecordBatch) -> Iterator[tuple[int, list[dict], list, dict]]:
    """Number, witnesses, values and block sizes of each group of a batch."""
    lists = b.column(1)
    dirty, values = lists.flatten().flatten()
    counts, each = lists.value_lengths().to_pylist(), dirty.value_lengths().to_pylist()
    block, fact, n = dirty.flatten().flatten()
    pairs = [list(zip(*(x.to_pylist() for x in c.flatten()), strict=True)) for c in (block, fact)]
    values, n = values.to_pylist(), n.to_pylist()
    w = at = 0
    for k, many in enumerate(counts):
        ws, sizes = [], {}
        for length in each[w : w + many]:
            ws.append(dict(zip(pairs[0][at : at + length], pairs[1][at : at + length], strict=True)))
            sizes.update(zip(pairs[0][at : at + length], n[at : at + length], strict=True))
            at += length
        yield k, ws, values[w : w + many], sizes
        w += many


def _decided(groups: DataFrame, decide: Callable, columns: str) -> DataFrame:
    """ANSWER and what decide(witnesses, values, sizes) says of every group."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.bool_() if c.endswith("boolean") else pa.float64() for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                out = [decide(ws, values, sizes) for _, ws, values, sizes in _groups(b)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=[ANSWER, *names])

    return groups.mapInArrow(run, f"{ANSWER} {PAIR}, {columns}")


def _kept_blocks(db: Database, queries: tuple[Query, ...]) -> list[Column]:
    """Names of the blocks that an answer tells by itself: those whose key is bound to free variables."""
    found = set()
    for a in (a for q in queries for a in q.atoms):
        bound = {c.lower(): v for c, v in a.binds}
        key = tuple(bound.get(c.lower()) for c in db.tables[a.table].key)
        if set(key) <= set(queries[0].free):
            found.add((a.table, key))
    return [name(F.lit(t), *map(F.col, key)) for t, key in sorted(found)]


def narrowed(found: DataFrame, free: tuple[str, ...], blocks: list[Column]) -> DataFrame:
    """Different answers and DIRTY, without the answers that are lost; DIRTY is null for those that are certain.

    An answer is certain if a witness has no dirty block, or if all have one
    and the same block only and its rows are all there. It is lost if all have
    one block and some row of it is missing. That is seen among the answer's
    witnesses alone, in windows; what is left needs to be searched.
    """
    w = Window.partitionBy(*free)
    only = F.when(F.size(DIRTY) == 1, F.get(F.col(DIRTY), F.lit(0)))
    of = lambda block: F.get(F.filter(DIRTY, lambda d: d["block"] == block), F.lit(0))
    sure, lost = F.max(F.size(DIRTY) == 0).over(w), F.lit(False)
    for k, d in enumerate([only, *map(of, blocks)]):
        at, rank = own("at", k), own("rank", k)
        found = found.withColumn(at, d).withColumn(rank, F.dense_rank().over(w.orderBy(f"{at}.fact")))
        same = (F.count(at).over(w) == F.count("*").over(w)) & (F.min(f"{at}.block").over(w) == F.max(f"{at}.block").over(w))
        full = F.max(rank).over(w) == F.max(f"{at}.n").over(w)
        sure = sure | (same & full) if k == 0 else sure
        lost = lost | (same & ~full)
    found = found.select(*free, DIRTY, F.coalesce(sure, F.lit(False)).alias(own("sure", 0)), F.coalesce(lost, F.lit(False)).alias(own("lost", 0)))
    found = found.where(f"{own('sure', 0)} OR NOT {own('lost', 0)}")
    return found.select(*free, F.when(~F.col(own("sure", 0)), F.col(DIRTY)).alias(DIRTY)).distinct()


def by_search(db: Database, *queries: Query) -> DataFrame:
    """Certain answers of a query, or of the union of several with the same free variables."""
    free = queries[0].free
    if any(q.free != free for q in queries):
        raise ValueError("the queries of a union have the same free variables")
    # answers that hold a key have few witnesses each, and so they are dealt by answer
    rows, keyed = db.rows(*queries), all(db.keyed(q) for q in queries)
    single = free and keyed and all(len(q.atoms) == 1 for q in queries)
    early = free and keyed and not single and len(set(free)) == len(free)
    found = None
    for q in queries:
        w = witnesses(db, q, queries, rows if early and len(queries) == 1 else 0).select(*free, DIRTY)
        found = w if found is None else found.unionAll(w)
    by_answer = lambda df: dealt(df, rows if keyed else 0, ANSWER)
    whole = (F.count_distinct(FACT) == F.first(SIZE)).alias("whole")
    if single:  # a witness has no block or one: nothing is left to search
        blocks = alone_in(by_answer(_named(found, free))).groupBy(ANSWER, *free, BLOCK).agg(whole)
        return blocks.where(F.col(BLOCK).isNull() | F.col("whole")).select(ANSWER, *free).distinct().select(*free)
    held = None
    if early:
        found = found if len(queries) == 1 else dealt(found, rows, *free)
        kept = stored(narrowed(found, free, _kept_blocks(db, queries)))
        held, found = kept.where(F.col(DIRTY).isNull()).select(*free), kept.where(F.col(DIRTY).isNotNull())
        rows = found.count()
    found = saved(by_answer(_named(found, free)).distinct().withColumn(VALUE, F.lit(1.0)))
    clean = by_answer(found.where(F.size(DIRTY) == 0).select(ANSWER)).distinct()
    if not free and not clean.isEmpty():
        return boolean(clean)
    alone, rest = parted(by_answer(found.where(F.size(DIRTY) > 0)).join(clean, ANSWER, "left_anti"), rows)
    sure = alone.groupBy(ANSWER, BLOCK).agg(whole).where("whole").select(ANSWER)
    easy = saved(by_answer(clean.unionAll(sure)).distinct())
    hard = _decided(gathered(by_answer(rest).join(by_answer(easy), ANSWER, "left_anti")), lambda ws, _, sizes: (not breakable(ws, sizes),), "held boolean").where("held").select(ANSWER)
    sure = by_answer(easy.unionAll(hard)).distinct()
    if not free:
        return boolean(sure)
    searched = by_answer(found.select(ANSWER, *free)).distinct().join(sure, ANSWER, "left_semi").select(*free)
    return searched if held is None else held.unionAll(searched)


SUMS = ["count_glb", "count_lub", "sum_glb", "sum_lub"]
EXTREMES = ["min_glb", "min_lub", "max_glb", "max_lub"]


def _measured(ws: list[dict], values: list, sizes: dict) -> tuple:
    """Bounds of a group: count_glb, count_lub, sum_glb, sum_lub, min_lub, max_glb."""
    ones = [(w, 1.0) for w in ws]
    given = [(w, v) for w, v in zip(ws, values, strict=True) if v is not None]
    negated = [(w, -v) for w, v in given]
    bottom, top = -least(negated, sizes, TOP), least(given, sizes, TOP)
    count = (least(ones, sizes, SUM), -least([(w, -v) for w, v in ones], sizes, SUM))
    return *count, least(given, sizes, SUM), -least(negated, sizes, SUM), None if bottom == inf else bottom, None if top == -inf else top


def all_ranges(db: Database, q: Query, value: str | None = None) -> DataFrame:
    """The free variables and count_glb ... max_lub of a variable, per certain group.

    COUNT counts all witnesses; null values add nothing to SUM, MIN and MAX.
    Where some repair has no value for a group, its min_lub and max_glb are
    null. Without free variables: no row if some repair has no witness.
    """
    v = F.col(value).cast("double") if value else F.lit(1.0)
    rows, keyed = db.rows(q), db.keyed(q)
    by_answer = lambda df: dealt(df, rows if keyed else 0, ANSWER)
    # each combination of different rows is one witness, and so none is there twice
    found = saved(_named(witnesses(db, q), q.free).select(ANSWER, *q.free, DIRTY, v.alias(VALUE)))
    simple = len(q.atoms) == 1  # no witness has two blocks
    dirty = found.where(F.size(DIRTY) > 0)
    alone, rest = (dealt(alone_in(dirty), rows, ANSWER, BLOCK), None) if simple else parted(dirty, rows)
    by_fact = alone.groupBy(ANSWER, BLOCK, FACT, SIZE).agg(F.count("*").cast("double").alias("c"), F.coalesce(F.sum(VALUE), F.lit(0.0)).alias("s"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"))
    full, valued = F.count("*") == F.first(SIZE), F.count("lo") == F.first(SIZE)
    or_none = lambda best, of: F.when(full, best).otherwise(of(best, F.lit(0.0)))
    blocks = by_fact.groupBy(ANSWER, BLOCK).agg(
        F.when(full, F.min("c")).otherwise(0.0).alias("count_glb"),
        F.max("c").alias("count_lub"),
        or_none(F.min("s"), F.least).alias("sum_glb"),
        or_none(F.max("s"), F.greatest).alias("sum_lub"),
        F.when(valued, F.max("lo")).alias("min_lub"),
        F.when(valued, F.min("hi")).alias("max_glb"),
    )
    columns = [*SUMS, "min_lub", "max_glb"]
    zero = F.coalesce(VALUE, F.lit(0.0))
    clean = found.where(F.size(DIRTY) == 0).select(ANSWER, F.lit(1.0).alias("count_glb"), F.lit(1.0).alias("count_lub"), zero.alias("sum_glb"), zero.alias("sum_lub"), F.col(VALUE).alias("min_lub"), F.col(VALUE).alias("max_glb"))
    parts = clean.unionByName(blocks.drop(BLOCK))
    if not simple:
        parts = parts.unionByName(_decided(gathered(rest), _measured, ", ".join(f"{c} double" for c in columns)))
    inner = by_answer(parts).groupBy(ANSWER).agg(*[F.sum(c).alias(c) for c in SUMS], F.min("min_lub").alias("min_lub"), F.max("max_glb").alias("max_glb")).where("count_glb > 0")
    outer = by_answer(found).groupBy(ANSWER).agg(*[F.first(c).alias(c) for c in q.free], F.min(VALUE).alias("min_glb"), F.max(VALUE).alias("max_lub"))
    counts = [F.col(c).cast("long").alias(c) if c.startswith("count") else F.col(c) for c in [*SUMS, *EXTREMES]]
    return inner.join(outer, ANSWER).select(*q.free, *counts)


def ranges_by_search(db: Database, q: Query, value: str | None = None) -> DataFrame:
    """glb and lub of COUNT (no value) or SUM of a variable, per certain group of the free variables."""
    kind = "sum" if value else "count"
    return all_ranges(db, q, value).select(*q.free, F.col(f"{kind}_glb").cast("double").alias("glb"), F.col(f"{kind}_lub").cast("double").alias("lub"))


def extremes_by_search(db: Database, q: Query, value: str) -> DataFrame:
    """min_glb, min_lub, max_glb, max_lub of a variable, per certain group of the free variables; see all_ranges()."""
    return all_ranges(db, q, value).select(*q.free, *EXTREMES)

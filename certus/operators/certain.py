"""Possible and certain answers of conjunctive queries.

A certain answer holds in every repair, that is, however one row is picked
from each block. Three ways lead to it, all of them lazy frames:

* the clean part: witnesses that use clean blocks only (sound);
* division, for first-order queries: from the last atom to the first, a block
  counts for an answer if each of its rows does;
* blocks, for forests: the same for a root atom and the atoms that are reached
  from it by their whole keys, each child aggregated before the join.

search.py handles what remains.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.operators.blocks import SIZE, dealt, used_columns, with_size
from certus.plans.analyze import attacks, order_by, self_join_free, trees
from certus.plans.query import OWN, Database, Query

#: Columns of witnesses() besides the variables.
WITNESS, DIRTY = f"{OWN}witness", f"{OWN}dirty"


def own(what: str, i: int) -> str:
    """The name of an internal column of the i-th atom."""
    return f"{OWN}{what}{i}"


def own_keys(db: Database, q: Query, i: int) -> list[str]:
    return [f"{own('key', i)}_{n}" for n in range(len(db.tables[q.atoms[i].table].key))]


def name(*columns: Column) -> Column:
    """128 bits that stand for some values; nulls are values of their own."""
    parts = [x for c in columns for x in (c, c.isNull())]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def named_columns(db: Database, q: Query, i: int, beside: tuple[Query, ...] = ()) -> list[str]:
    """Columns of an atom's table that the query, and those beside it, use."""
    table = q.atoms[i].table
    return sorted({c for x in (q, *beside) for b in x.atoms if b.table == table for c in used_columns(db.tables[table], b)})


def facts(db: Database, q: Query, i: int, ids: bool = False, beside: tuple[Query, ...] = ()) -> DataFrame:
    """Different rows of an atom over the columns that the query, and those beside it, use of its table.

    The variables, and as internal columns (see own()) the key, the block's
    size n and ok: the row meets the condition and binds equal columns alike.
    With ids also block and fact, which name blocks and rows across atoms.
    """
    a = q.atoms[i]
    table = db.tables[a.table]
    columns = named_columns(db, q, i, beside)
    rows = with_size(table, columns)
    first: dict[str, str] = {}
    alike = [F.expr(a.where)]
    for c, v in a.binds:
        if v in first:
            alike.append(F.col(c) == F.col(first[v]))
        first.setdefault(v, c)
    out = [F.col(c).alias(k) for c, k in zip(table.key, own_keys(db, q, i), strict=True)]
    out += [F.col(SIZE).alias(own("n", i)), F.coalesce(both(alike), F.lit(False)).alias(own("ok", i))]
    out += [F.col(c).alias(v) for v, c in first.items()]
    if ids:
        out += row_names(a.table, table.key, columns, own("block", i), own("fact", i))
    return rows.select(*out)


def row_names(table: str, key: tuple[str, ...], columns: list[str], block: str, fact: str, column: Callable[[str], Column] = F.col) -> list[Column]:
    rest = [c for c in columns if c not in key]
    return [name(F.lit(table), *map(column, key)).alias(block), name(F.lit(table), *map(column, [*key, *rest])).alias(fact)]


def joined(left: DataFrame, right: DataFrame, left_variables: set[str], right_variables: set[str], rows: int = 0) -> DataFrame:
    """Natural join; atoms that share no variable give all their pairs, which is then the query's own meaning.

    rows: about how many the larger side has.
    """
    shared = sorted(left_variables & right_variables)
    return dealt(left, rows, *shared).join(dealt(right, rows, *shared), shared) if shared else left.crossJoin(right)


def by_root(db: Database, q: Query, i: int, rows: DataFrame) -> DataFrame:
    """Joined rows dealt by the block that they have in an atom, by its variables where the key is bound."""
    bound = {c.lower(): v for c, v in q.atoms[i].binds}
    keys = [bound.get(c.lower(), k) for c, k in zip(db.tables[q.atoms[i].table].key, own_keys(db, q, i), strict=True)]
    return dealt(rows, db.tables[q.atoms[i].table].rows, *keys)


def different(db: Database, q: Query, found: DataFrame) -> DataFrame:
    """The different answers among rows."""
    found = found.select(*q.free)
    return (dealt(found, db.rows(q), *q.free) if db.keyed(q) else found).distinct()


def _names_later(db: Database, q: Query, i: int, held: set[str], beside: tuple[Query, ...]) -> list[Column] | None:
    """Block and fact of an atom from its variables, where those that no earlier atom holds have all of its columns."""
    a, first = q.atoms[i], {}
    for c, v in a.binds:
        first.setdefault(v, c.lower())
    by = {c: v for v, c in first.items() if v not in held}
    key, columns = db.tables[a.table].key, named_columns(db, q, i, beside)
    if sum(b.table == a.table for b in q.atoms) > 1 or not {c.lower() for c in (*key, *columns)} <= set(by):
        return None
    return row_names(a.table, key, columns, own("block", i), own("fact", i), lambda c: F.col(by[c.lower()]))


def witnesses(db: Database, q: Query, beside: tuple[Query, ...] = (), by_answer: int = 0) -> DataFrame:
    """One row per combination of rows that gives an answer; beside: queries in union with this one.

    The variables, WITNESS (names the combination) and DIRTY: block, row and
    block size of each of its rows that is not alone in its block. by_answer:
    about how many there are, dealt by the free variables. Names are random
    bits that don't compress, so only those of rows in dirty blocks are
    shuffled, and none of an atom whose variables tell them.
    """
    out, variables, later, n = None, set(), [], range(len(q.atoms))
    for i, a in enumerate(q.atoms):
        ok, block, fact = own("ok", i), own("block", i), own("fact", i)
        rows = facts(db, q, i, True, beside).where(ok).drop(ok, *own_keys(db, q, i))
        names = _names_later(db, q, i, variables, beside)
        if names:
            later += names
            rows = rows.drop(block, fact)
        else:
            dirty = F.when(F.col(own("n", i)) > 1, F.struct(F.col(block).alias("block"), F.col(fact).alias("fact")))
            rows = rows.withColumn(own("names", i), dirty).drop(block)
        out = rows if out is None else joined(out, rows, variables, a.variables, db.rows(q))
        variables |= a.variables
        for j in range(i):  # two rows of one block are never kept together
            if q.atoms[j].table == a.table:
                one, two = F.col(own("names", i)), F.col(own("names", j))
                out = out.where(F.coalesce((one["block"] != two["block"]) | (one["fact"] == two["fact"]), F.lit(True)))
    out = dealt(out, by_answer, *q.free).select("*", *later)
    each = []
    for i in n:
        names, size = own("names", i), F.col(own("n", i))
        told = [F.col(names)[x].alias(x) if names in out.columns else F.col(own(x, i)).alias(x) for x in ("block", "fact")]
        each.append(F.when(size > 1, F.struct(*told, size.alias("n"))))
    dirty = F.array_sort(F.array_distinct(F.filter(F.array(*each), lambda x: x.isNotNull())))
    return out.select(*sorted(variables), name(*[F.col(own("fact", i)) for i in n]).alias(WITNESS), dirty.alias(DIRTY))


def answer_columns(q: Query) -> list[Column]:
    return [F.col(v) for v in q.free] or [F.lit(True).alias("cons_answer")]


def boolean(found: DataFrame) -> DataFrame:
    """One row, cons_answer: whether a frame has rows."""
    return found.limit(1).agg((F.count("*") > 0).alias("cons_answer"))


def possible_rows(db: Database, q: Query) -> DataFrame:
    """The variables of every combination of rows, as they are, that gives an answer."""
    out, variables = None, set()
    for a in q.atoms:
        table, first = db.tables[a.table], {}
        rows = table.frame.where(F.expr(a.where))
        for c, v in a.binds:
            if v in first:
                rows = rows.where(F.col(c) == F.col(first[v]))
            first.setdefault(v, c)
        rows = rows.select(*[F.col(c).alias(v) for v, c in first.items()])
        out = rows if out is None else joined(out, rows, variables, a.variables, db.rows(q))
        variables |= a.variables
    return out


def possible(db: Database, q: Query) -> DataFrame:
    """Answers of the query on the rows as they are."""
    out = possible_rows(db, q)
    return different(db, q, out) if q.free else boolean(out)


def suspect(db: Database, q: Query, sure: DataFrame) -> DataFrame:
    """Possible answers that aren't among the certain ones, in one grouping of both."""
    if not q.free:
        return possible(db, q).exceptAll(sure)
    held = f"{OWN}held"
    found = possible_rows(db, q).select(*q.free, F.lit(False).alias(held)).unionByName(sure.select(*q.free, F.lit(True).alias(held)))
    found = dealt(found, db.rows(q), *q.free) if db.keyed(q) else found
    return found.groupBy(*q.free).agg(F.max(held).alias(held)).where(~F.col(held)).select(*q.free)


def from_clean_part(db: Database, q: Query) -> DataFrame:
    """Answers that a witness without dirty blocks gives; each of them is certain."""
    out = witnesses(db, q).where(F.size(DIRTY) == 0)
    return different(db, q, out) if q.free else boolean(out)


def relevant_facts(db: Database, q: Query, i: int) -> DataFrame:
    """Rows of the i-th atom's table, over the columns that the query uses, in dirty blocks that a witness touches."""
    table, block = db.tables[q.atoms[i].table], own("block", i)
    touched = dealt(witnesses(db, q).select(F.explode(DIRTY).alias("d")).select(F.col("d.block").alias(block)), db.rows(q), block).distinct()
    columns = sorted({c for a in q.atoms if a.table == q.atoms[i].table for c in used_columns(table, a)})
    rows = with_size(table, columns).drop(SIZE)
    rows = rows.withColumn(block, row_names(q.atoms[i].table, table.key, columns, block, block)[0])
    return dealt(rows, db.rows(q), block).join(touched, block, "left_semi").drop(block)


def by_division(db: Database, q: Query) -> DataFrame:
    """Certain answers of a first-order query, atom by atom in the attack graph's order."""
    order = order_by(set(attacks(db, q)), len(q.atoms))
    if order is None or not self_join_free(q):
        raise ValueError("a self-join or a cycle in the attack graph: the query isn't known to be first-order")
    later, held, rows_of, size_of = None, set(), f"{OWN}rows", f"{OWN}of"
    for place in range(len(order) - 1, -1, -1):
        i = order[place]
        a = q.atoms[i]
        outer = set(q.free).union(*[q.atoms[j].variables for j in order[:place]])
        rows = facts(db, q, i).where(own("ok", i)).drop(own("ok", i))
        if later is not None:
            rows = by_root(db, q, i, joined(rows, later, a.variables, held, db.rows(q)))
        held = (a.variables | held) & outer
        whole = rows.groupBy(*own_keys(db, q, i), *sorted(held)).agg(F.count("*").alias(rows_of), F.first(own("n", i)).alias(size_of)).where(f"{rows_of} = {size_of}")
        later = whole.select(*sorted(held)).distinct() if held else boolean(whole).where("cons_answer").drop("cons_answer")
    return later.select(*q.free) if q.free else boolean(later)


#: Columns of covered() besides the root's key and the free variables.
WHOLE, FULL, LOW, HIGH = f"{OWN}whole", f"{OWN}full", f"{OWN}low", f"{OWN}high"


def _reached(db: Database, q: Query, i: int, parent: dict[int, int | None]) -> tuple[DataFrame, set[str]]:
    """Rows of an atom that give an answer with some rows below it; OWN + "sure": with all repairs of what is below it."""
    sure, whole = f"{OWN}sure", f"{OWN}all"
    rows = facts(db, q, i).where(own("ok", i)).drop(own("ok", i)).withColumn(sure, F.lit(True))
    variables = set(q.atoms[i].variables)
    for j in sorted(j for j, p in parent.items() if p == i):
        below, inner = _reached(db, q, j, parent)
        keep = sorted(db.key_variables(q.atoms[j]) | (inner & set(q.free)))
        child = below.groupBy(*keep).agg((F.count(F.when(F.col(sure), 1)) == F.first(own("n", j))).alias(whole))
        rows = joined(rows, child, variables, set(keep), db.rows(q)).withColumn(sure, F.col(sure) & F.col(whole)).drop(whole)
        variables |= set(keep)
    return rows, variables


def covered(db: Database, q: Query, value: str | None = None) -> DataFrame:
    """For a tree of atoms: by root block and answer, what the block contributes.

    Every atom but the root is reached by its whole key from another one; the
    root is found from the variables, whatever the order of the atoms. WHOLE:
    every row of the root block gives the answer in every repair of the rest.
    FULL: every row gives it in some repair. LOW and HIGH: smallest and
    largest value of the root's rows that give it (nulls left out).
    """
    found = trees(db, q, value)
    if found is None or len(found) != 1:
        raise ValueError("the atoms aren't one tree of joins to whole keys")
    root, parent = found[0]
    if value and value not in q.atoms[root].variables:
        raise ValueError(f"{value} isn't bound by the root")
    rows, _ = _reached(db, q, root, parent)
    rows = by_root(db, q, root, rows) if len(q.atoms) > 1 else rows
    n, v = F.first(own("n", root)), F.col(value) if value else F.lit(1)
    whole = F.count(F.when(F.col(f"{OWN}sure"), 1)) == n
    return rows.groupBy(*own_keys(db, q, root), *q.free).agg(whole.alias(WHOLE), (F.count("*") == n).alias(FULL), F.min(v).alias(LOW), F.max(v).alias(HIGH))


def by_blocks(db: Database, q: Query) -> DataFrame:
    """Certain answers of a forest; trees share free variables only, so each is decided on its own."""
    found = trees(db, q)
    if found is None:
        raise ValueError("the atoms aren't trees of joins to whole keys")
    out, variables = None, set()
    for root, parent in found:
        atoms = tuple(q.atoms[i] for i in sorted(parent))
        free = tuple(v for v in q.free if any(v in a.variables for a in atoms))
        sure = covered(db, Query(free, atoms), None).where(WHOLE)
        sure = sure.select(*free).distinct() if free else boolean(sure).where("cons_answer").drop("cons_answer")
        out = sure if out is None else joined(out, sure, variables, set(free))
        variables |= set(free)
    return out.select(*q.free) if q.free else boolean(out)

"""Denial constraints: violations, rows that every repair keeps, certain answers.

A repair is a largest set of rows without a violation. Constraints of the kind
"rows that agree here agree there" (see agreeing()) are looked at by classes of
rows; others by their violations, which are joins. An answer isn't certain if
some repair breaks each of its witnesses. A repair leaves a row out only if it
keeps the rest of a violation of that row, so what is looked for is a set
without violations that holds such a rest for a row of every witness. Rows
that hang together by violations or witnesses are components, and each is
searched on its own, without a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certus.functions.storage import saved
from certus.operators.certain import boolean, both, joined, name
from certus.operators.components import connected_components
from certus.operators.search import ANSWER, PAIR, PART
from certus.plans.query import OWN, Atom, Chain, Database, Denial, Query

FACT = f"{OWN}fact"


def named(db: Database, table: str) -> DataFrame:
    """The different rows of a table, with the name of each, FACT."""
    rows = db.tables[table].frame.dropDuplicates()
    return rows.withColumn(FACT, name(F.lit(table), *map(F.col, rows.columns)))


def violations(db: Database, denial: Denial) -> DataFrame:
    """facts: the names of the rows of each violation, ascending."""
    out, names = None, []
    for alias, table in denial.aliases:
        rows = named(db, table).alias(alias)
        names.append(f"{alias}.{FACT}")
        out = rows if out is None else out.crossJoin(rows)  # the condition below makes it a join
    out = out.where(F.expr(denial.condition))
    if denial.symmetric:
        for a, b in zip(names, names[1:], strict=False):
            out = out.where(F.col(a) < F.col(b))
    return out.select(F.array_sort(F.array_distinct(F.array(*names))).alias("facts")).distinct()


def all_violations(db: Database) -> DataFrame:
    """facts of the violations of all constraints, those that hold a smaller one left out.

    Each violation asks for its proper subsets by name, so no row's violations
    are compared with each other.
    """
    out = None
    for denial in db.denials:
        v = violations(db, denial)
        out = v if out is None else out.unionAll(v)
    if out is None:
        raise ValueError("the database has no denial constraints")
    out = saved(out.distinct())
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("facts")) - 2).cast("int"))
    within = lambda m: F.filter("facts", lambda f, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    parts = out.where("size(facts) > 1").select("facts", F.explode(F.transform(masks, within)).alias("part"))
    larger = parts.join(out.select(F.col("facts").alias("part")), "part", "left_semi").select("facts")
    return out.join(larger, "facts", "left_anti")


def countable(denials: list[Denial]) -> bool:
    """Whether violation_counts() can do without the violations themselves.

    So it is for chains over one table that agree on the same columns and rise
    in the same one; a chain without an order comes before those with one.
    """
    chains = [d.chain for d in sorted(denials, key=lambda d: len(d.aliases))]
    if not chains or None in chains or len({d.aliases[0][1] for d in denials}) > 1:
        return False
    longer = [c for c in chains if len(c.rows) > 1]
    ordered = [c.by is not None for c in longer]
    return len({c.same for c in longer}) <= 1 and len({c.by for c in longer if c.by}) <= 1 and ordered == sorted(ordered)


def violation_counts(db: Database) -> DataFrame:
    """n_rows, n_violations: how many violations of each size hold no smaller one.

    Those of chains are counted by running sums over their rows in order; see
    countable(). Others are written out.
    """
    if not countable(db.denials):
        return all_violations(db).groupBy(F.size("facts").alias("n_rows")).agg(F.count("*").alias("n_violations"))
    table = db.denials[0].aliases[0][1]
    rows = named(db, table).alias("r")
    meets = lambda c: F.coalesce(F.expr(c.format(r="r")), F.lit(False))
    chains = sorted((d.chain for d in db.denials), key=lambda c: len(c.rows))  # a sort that keeps the order of equals
    single = [meets(c.rows[0]) for c in chains if len(c.rows) == 1]
    longer = [c for c in chains if len(c.rows) > 1]
    out = None
    if single:
        out = rows.where(~both([~x for x in single])).agg(F.count("*").alias("n_violations")).select(F.lit(1).alias("n_rows"), "n_violations")
        rows = rows.where(both([~x for x in single]))
    for i, c in enumerate(longer):
        n = _chains(rows, c, longer[:i], meets).select(F.lit(len(c.rows)).alias("n_rows"), "n_violations")
        out = n if out is None else out.unionAll(n)
    return out.groupBy("n_rows").agg(F.sum("n_violations").alias("n_violations")).where("n_violations > 0")


def _chains(rows: DataFrame, chain: Chain, before: list[Chain], meets: Callable[[str], Column]) -> DataFrame:
    """n_violations: the number of chains in rows that hold none of those before.

    The chains that end at a row are counted by their length and by how much
    of each chain before is found in them, the first fitting rows taken: a row
    lengthens the chains that end at lower ones, whose sum is a running one.
    """
    conditions = sorted({x for c in (chain, *before) for x in c.rows})
    flag = {x: f"{OWN}flag{k}" for k, x in enumerate(conditions)}
    keys, order, n = [f"{OWN}s{k}" for k in range(len(chain.same))], f"{OWN}by", f"{OWN}n"
    alike = rows.select(*[F.col(f"r.`{c}`").alias(k) for c, k in zip(chain.same, keys, strict=True)], F.col(f"r.`{chain.by}`" if chain.by else FACT).alias(order), *[meets(x).alias(flag[x]) for x in conditions])
    alike = alike.where(both([F.col(k).isNotNull() for k in [*keys, order]])).groupBy(*keys, order, *flag.values()).agg(F.count("*").alias(n))
    upto = Window.partitionBy(*keys).orderBy(order)
    level = Window.partitionBy(*keys, order)
    states = list(product(*[range(len(c.rows)) for c in before]))
    column = {s: f"{OWN}in_{'_'.join(map(str, s))}" for s in states}

    def after(state: tuple[int, ...], ends: Column) -> list[tuple[Column, tuple[int, ...]]]:
        """The states that a row leads to from one, each with the condition on the row."""
        found = [(ends, ())]
        for c, k in zip(before, state, strict=True):
            hit = F.col(flag[c.rows[k]])
            found = [x for on, s in found for x in ((on & ~hit, (*s, k)), (on & hit, (*s, k + 1)))]
            found = [(on, s) for on, s in found if s[-1] < len(c.rows)]
        return found

    start = (0,) * len(before)
    reached, sums = [start], {start: F.lit(1)}
    for condition in chain.rows:
        into: dict = {}
        for s in reached:
            for on, t in after(s, F.col(flag[condition])):
                into.setdefault(t, []).append(F.when(on, F.col(n) * sums[s]).otherwise(0))
        reached = sorted(into)
        alike = alike.select(*keys, order, *flag.values(), n, *[sum(into[t][1:], into[t][0]).alias(column[t]) for t in reached])
        # of chains that end lower: those up to here but those that end level with it
        sums = {t: F.sum(column[t]).over(upto) - F.sum(column[t]).over(level) for t in reached}
    return alike.agg(F.coalesce(F.sum(sum(map(F.col, map(column.get, reached)), F.lit(0))), F.lit(0)).alias("n_violations"))


def _of_table(db: Database, table: str) -> tuple[list[Denial], list[Denial], list[Denial]]:
    """Constraints that mention a table: on single rows, of agreement, others."""
    own = [d for d in db.denials if any(t == table for _, t in d.aliases)]
    single = [d for d in own if len(d.aliases) == 1]
    agree = [d for d in own if d.same]
    return single, agree, [d for d in own if d not in single and d not in agree]


def _allowed(db: Database, table: str, single: list[Denial]) -> DataFrame:
    """Different rows that no constraint on single rows forbids."""
    rows = db.tables[table].frame.dropDuplicates()
    for d in single:
        rows = rows.alias(d.aliases[0][0]).where(~F.coalesce(F.expr(d.condition), F.lit(False)))
    return rows


def conflict_counts(db: Database, denial: Denial) -> DataFrame:
    """For a constraint of agreement: its columns ``same`` and n_violations, the number of pairs that violate it."""
    if not denial.same:
        raise ValueError("not a constraint of agreement")
    rows = db.tables[denial.aliases[0][1]].frame.dropDuplicates().dropna(subset=[*denial.same, *denial.differs])
    n, keys = f"{OWN}n", list(denial.same)
    classes = rows.groupBy(*keys, *denial.differs).agg(F.count("*").alias(n))
    pairs = ((F.sum(n) * F.sum(n) - F.sum(F.col(n) * F.col(n))) / 2).cast("long")
    return classes.groupBy(*keys).agg(pairs.alias("n_violations")).where("n_violations > 0")


def in_every_repair(db: Database, table: str) -> DataFrame:
    """Rows of a table that are in no smallest violation."""
    single, agree, others = _of_table(db, table)
    if others:
        touched = all_violations(db).select(F.explode("facts").alias(FACT)).distinct()
        return named(db, table).join(touched, FACT, "left_anti").drop(FACT)
    rows = _allowed(db, table, single)
    for d in agree:
        differing = rows.dropna(subset=[*d.same, *d.differs]).groupBy(*d.same).agg((F.min(d.differs[0]) != F.max(d.differs[0])).alias(f"{OWN}bad")).where(f"{OWN}bad")
        bad = differing.select(*d.same).alias("bad")
        on = [F.col(f"rows.`{c}`") == F.col(f"bad.`{c}`") for c in d.same] + [F.col(f"rows.`{d.differs[0]}`").isNotNull()]
        rows = rows.alias("rows").join(bad, on, "left_anti")
    return rows


def certain_values(db: Database, table: str, columns: list[str]) -> DataFrame:
    """Values of some columns of a table that every repair under the denial constraints holds.

    Under one constraint of agreement a repair keeps one class of each key
    whole, so a value is certain if every class of some key has it.
    """
    single, agree, others = _of_table(db, table)
    if others or len(agree) > 1:
        variables = [f"v{i}" for i in range(len(columns))]
        q = Query(tuple(variables), (Atom(table, tuple(zip(columns, variables, strict=True))),))
        return certain_answers(db, q).toDF(*columns)
    rows = _allowed(db, table, single)
    if not agree:
        return rows.select(*columns).distinct()
    d = agree[0]
    keys, kept, kind = [f"{OWN}s{i}" for i in range(len(d.same))], [f"{OWN}v{i}" for i in range(len(columns))], f"{OWN}kind"
    rows = rows.select(*[F.col(c).alias(k) for c, k in zip(d.same, keys, strict=True)], F.col(d.differs[0]).alias(kind), *[F.col(c).alias(k) for c, k in zip(columns, kept, strict=True)])
    tied = rows.dropna(subset=[*keys, kind]).distinct()
    # of tied rows, one per key, class and value is left
    all_kinds = tied.groupBy(*keys).agg(F.count_distinct(kind).alias(f"{OWN}n"))
    with_value = tied.groupBy(*keys, *kept).agg(F.count("*").alias(f"{OWN}m"))
    sure = with_value.join(all_kinds, keys).where(f"{OWN}m = {OWN}n").select(*kept)
    untied = rows.where(" or ".join(f"{k} is null" for k in [*keys, kind])).select(*kept)
    return sure.unionAll(untied).distinct().toDF(*columns)


def _witnesses(db: Database, q: Query) -> DataFrame:
    """The free variables and facts, the names of the rows of each combination that gives an answer."""
    out, variables, names = None, set(), []
    for i, a in enumerate(q.atoms):
        rows, first = named(db, a.table).where(F.expr(a.where)), {}
        for c, v in a.binds:
            if v in first:
                rows = rows.where(F.col(c) == F.col(first[v]))
            first.setdefault(v, c)
        names.append(f"{FACT}{i}")
        rows = rows.select(*[F.col(c).alias(v) for v, c in first.items()], F.col(FACT).alias(names[-1]))
        out = rows if out is None else joined(out, rows, variables, a.variables)
        variables |= a.variables
    return out.select(*q.free, F.array_sort(F.array_distinct(F.array(*names))).alias(f"{OWN}facts"))


def _parts(ws: list[frozenset], options: list[list[frozenset]], conflicts: list[frozenset]) -> list[list[int]]:
    """Witnesses whose options meet, in a row or through a conflict, together."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for k, own in enumerate(options):
        for f in set().union(*own):
            up[top(f)] = top(k)
    for c in conflicts:
        if all(f in up for f in c):
            first, *rest = c
            for f in rest:
                up[top(f)] = top(first)
    parts: dict = {}
    for k in range(len(ws)):
        parts.setdefault(top(k), []).append(k)
    return list(parts.values())


def _chosen(options: list[list[frozenset]], of: dict) -> bool:
    """Whether one option of each list can be taken without a conflict among all that is taken."""
    taken: set = set()

    def fits(o: frozenset) -> bool:
        return not any(all(x in taken or x in o for x in c) for f in o if f not in taken for c in of[f])

    frames: list[tuple[set, Iterator]] = []
    while True:
        best = None
        for own in options:
            if any(o <= taken for o in own):
                continue
            fitting = [o for o in own if fits(o)]
            if best is None or len(fitting) < len(best):
                best = fitting
            if not best:
                break
        if best is None:
            return True
        frames.append((set(), iter(best)))
        while frames:
            added, rest = frames[-1]
            taken -= added
            option = next(rest, None)
            if option is None:
                frames.pop()
                continue
            frames[-1] = (option - taken, rest)
            taken |= option
            break
        if not frames:
            return False


def avoidable(ws: list[frozenset], conflicts: list[frozenset]) -> bool:
    """Whether some largest set without a conflict holds none of the witnesses whole; each of their rows has a conflict."""
    of: dict = {}
    for c in conflicts:
        for f in c:
            of.setdefault(f, []).append(c)
    options = []
    for w in ws:
        own = {c - {f} for f in w for c in of[f]}
        options.append([o for o in own if not any(p < o for p in own)])
    return all(_chosen([options[k] for k in part], of) for part in _parts(ws, options, conflicts))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components, as lists of (answer or null, rows), to the answers that no repair of theirs avoids."""
    for b in batches:
        for items in b.column(0):
            conflicts, of_answer = [], {}
            for x in items.as_py():
                facts = frozenset((f["a"], f["b"]) for f in x["facts"])
                if x["answer"] is None:
                    conflicts.append(facts)
                else:
                    of_answer.setdefault((x["answer"]["a"], x["answer"]["b"]), []).append(facts)
            held = [a for a, ws in of_answer.items() if not avoidable(ws, conflicts)]
            pairs = pa.array([{"a": x, "b": y} for x, y in held], pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pairs], names=[ANSWER])


def certain_answers(db: Database, *queries: Query) -> DataFrame:
    """Answers of a query, or of a union of several, that hold in every repair under the denial constraints."""
    free, facts = queries[0].free, f"{OWN}facts"
    if any(q.free != free for q in queries):
        raise ValueError("the queries of a union have the same free variables")
    found = None
    for q in queries:
        found = _witnesses(db, q) if found is None else found.unionAll(_witnesses(db, q))
    found = saved(found.withColumn(ANSWER, name(*[F.col(v) for v in free] or [F.lit(1)])).distinct())
    conflicts = saved(all_violations(db))
    status = conflicts.select(F.explode("facts").alias(FACT), (F.size("facts") == 1).alias("gone")).groupBy(FACT).agg(F.max("gone").alias("gone"))
    each = found.select(ANSWER, facts, F.explode(facts).alias(FACT)).join(status, FACT, "left")
    left = each.groupBy(ANSWER, facts).agg(F.max(F.coalesce("gone", F.lit(False))).alias("gone"), F.array_sort(F.collect_list(F.when(F.col("gone").isNotNull(), F.col(FACT)))).alias("open")).where("not gone")
    left = saved(left.select(ANSWER, "open").distinct())
    clean = left.where("size(open) = 0").select(ANSWER).distinct()
    unsure = left.where("size(open) > 0").join(clean, ANSWER, "left_anti")
    linked = conflicts.where("size(facts) > 1").select(F.lit(None).cast(PAIR).alias("answer"), "facts")
    items = unsure.select(F.col(ANSWER).alias("answer"), F.col("open").alias("facts")).unionByName(linked)
    roots = connected_components(items.select(F.col("facts")[0].alias("a"), F.explode("facts").alias("b")))
    items = items.withColumn("node", F.col("facts")[0]).join(roots.withColumnRenamed("root", PART), "node", "left").withColumn(PART, F.coalesce(PART, "node")).drop("node")
    asked = items.where("answer is not null").select(PART).distinct()
    groups = items.join(asked, PART, "left_semi").groupBy(PART).agg(F.collect_list(F.struct("answer", "facts")).alias("items")).select("items")
    sure = clean.unionAll(groups.mapInArrow(_decide, f"{ANSWER} {PAIR}")).distinct()
    return found.select(ANSWER, *free).distinct().join(sure, ANSWER, "left_semi").select(*free) if free else boolean(sure)

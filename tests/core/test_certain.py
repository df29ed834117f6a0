"""Certain answers and ranges against all repairs of small databases."""

import itertools
import random

import pytest

from certus.engine import Engine
from certus.operators import certain, denial, elimination, ranges, search
from certus.plans.query import Atom, Database, Denial, Query, agreeing, atom


def repairs(rows, keys):
    """All ways to keep one row of each block; rows and keys by table."""
    blocks = []
    for name, own in rows.items():
        by = {}
        for r in dict.fromkeys(own):
            by.setdefault(tuple(r[k] for k in range(keys[name])), []).append((name, r))
        blocks += by.values()
    for pick in itertools.product(*blocks):
        out = {name: [] for name in rows}
        for name, r in pick:
            out[name].append(r)
        yield out


EMP = [(1, "toys", 10), (1, "books", 10), (2, "toys", 20), (3, "games", 30), (3, "games", 35), (4, "books", -5), (4, "books", 5), (4, "books", 5)]
DEPT = [("toys", "NY"), ("books", "NY"), ("games", "SF"), ("games", "LA")]


@pytest.fixture(scope="module")
def company(spark):
    db = Database()
    db.register("emp", spark.createDataFrame(EMP, "id int, dept string, sal int"), ["id"])
    return db.register("dept", spark.createDataFrame(DEPT, "dept string, city string"), ["dept"])


def values(df):
    return {tuple(r) if len(r) > 1 else r[0] for r in df.collect()}


WORKS = (atom("emp", id="id", dept="d"), atom("dept", dept="d", city="city"))


@pytest.mark.parametrize(
    ("q", "sure", "may"),
    [
        (Query(("id",), (atom("emp", id="id"),)), {1, 2, 3, 4}, {1, 2, 3, 4}),
        (Query(("id", "dept"), (atom("emp", id="id", dept="dept"),)), {(2, "toys"), (3, "games"), (4, "books")}, {(1, "toys"), (1, "books"), (2, "toys"), (3, "games"), (4, "books")}),
        (Query(("id", "city"), WORKS), {(1, "NY"), (2, "NY"), (4, "NY")}, {(1, "NY"), (2, "NY"), (4, "NY"), (3, "SF"), (3, "LA")}),
        (Query(("city",), WORKS), {"NY"}, {"NY", "SF", "LA"}),
        (Query(("id",), (atom("emp", "sal >= 10", id="id"),)), {1, 2, 3}, {1, 2, 3}),
        (Query((), (WORKS[0], atom("dept", "city = 'SF'", dept="d"))), {False}, {True}),
    ],
)
def test_company(company, q, sure, may):
    e = Engine(company)
    assert values(e.possible(q)) == may
    for strategy in ("auto", "division", "blocks", "search"):
        assert values(e.certain(q, strategy=strategy)) == sure, strategy
    assert values(e.certain(q, strategy="clean")) <= sure | {False}


def test_company_ranges(company):
    e = Engine(company)
    emp = lambda where="true", **b: atom("emp", where, id="id", sal="v", **b)
    r = e.ranges(Query((), (emp(),)), "v").first()
    assert (r.count_glb, r.count_lub, r.sum_glb, r.sum_lub, r.min_glb, r.min_lub, r.max_glb, r.max_lub) == (4, 4, 55, 70, -5, 5, 30, 35)
    r = e.ranges(Query((), (emp("dept = 'books'"),)), "v").first()
    assert (r.cons_answer, r.count_glb, r.count_lub) == (True, 1, 2)
    got = {x.dept: tuple(x)[1:] for x in e.ranges(Query(("dept",), (emp(dept="dept"),)), "v").collect()}
    assert got == {"toys": (1, 2, 20, 30, 10, 20, 20, 20), "books": (1, 2, -5, 15, -5, 5, -5, 10), "games": (1, 1, 30, 35, 30, 35, 30, 35)}
    q = Query((), (emp(dept="d"), atom("dept", "city = 'NY'", dept="d")))
    assert tuple(e.ranges(q, "v", "sum").first()) == (True, 25, 35)
    for f in ("avg", "count distinct"):
        with pytest.raises(ranges.UnsupportedAggregate):
            e.ranges(q, "v", f)
    q = Query((), (emp("sal > 0", dept="d"), atom("dept", "city = 'SF'", dept="d")))
    assert not e.ranges(q, "v").first().cons_answer
    ny = Query((), (emp(dept="d"), atom("dept", "city = 'NY'", dept="d")))
    assert tuple(search.ranges_by_search(company, ny, "v").first()) == (25, 35)


def test_hard_patterns(spark):
    def certain_of(r, s, keys_of_s):
        db = Database().register("r", spark.createDataFrame(r, "a string, b string"), ["a"])
        db.register("s", spark.createDataFrame(s, "c string, d string"), ["c"])
        return Engine(db).certain(Query((), (atom("r", a="x", b="z"), atom("s", **keys_of_s)))).first()[0]

    shared = {"c": "y", "d": "z"}
    assert not certain_of([("1", "a"), ("1", "b"), ("2", "a"), ("2", "c")], [("1", "a"), ("1", "c"), ("2", "b"), ("2", "a")], shared)
    assert certain_of([("1", "a"), ("1", "b")], [("1", "a"), ("2", "b")], shared)
    cycle = {"c": "z", "d": "x"}
    assert certain_of([("1", "a"), ("1", "b"), ("2", "a")], [("a", "1"), ("a", "2"), ("b", "1")], cycle)
    assert not certain_of([("1", "a"), ("1", "b"), ("2", "b"), ("2", "a")], [("a", "1"), ("a", "2"), ("b", "2"), ("b", "1")], cycle)


def evaluate(kept, shape):
    if shape == "path":
        return {(x,) for x, y in kept["r"] for y2, z in kept["s"] if y == y2}
    if shape == "value":
        return {(z,) for x, y in kept["r"] for y2, z in kept["s"] if y == y2 and z > 0}
    if shape == "hard":
        return {()} if any(y == z for x, y in kept["r"] for _, z in kept["s"]) else set()
    if shape == "self":
        return {(x,) for x, y in kept["r"] for x2, y2 in kept["r"] if y == x2 and y2 > 0}
    return {(x,) for x, y in kept["r"] if y > 0} | {(x,) for x, y in kept["r"] if x == y}


SHAPES = {
    "path": [Query(("x",), (atom("r", a="x", b="y"), atom("s", c="y")))],
    "value": [Query(("z",), (atom("r", b="y"), atom("s", "d > 0", c="y", d="z")))],
    "hard": [Query((), (atom("r", a="x", b="z"), atom("s", c="y", d="z")))],
    "self": [Query(("x",), (atom("r", a="x", b="y"), atom("r", "b > 0", a="y")))],
    "union": [Query(("x",), (atom("r", "b > 0", a="x"),)), Query(("x",), (atom("r", a="x", b="x"),))],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("seed", [1, 2])
def test_random_databases(spark, shape, seed):
    r = random.Random(seed * 7 + len(shape))
    make = lambda: [(r.randrange(4), r.randrange(4)) for _ in range(7)]
    rows = {"r": make(), "s": make()}
    worlds = [evaluate(k, shape) for k in repairs(rows, {"r": 1, "s": 1})]
    want = set.intersection(*worlds)
    db = Database().register("r", spark.createDataFrame(rows["r"], "a int, b int"), ["a"])
    db.register("s", spark.createDataFrame(rows["s"], "c int, d int"), ["c"])
    got = Engine(db).certain(*SHAPES[shape])
    assert ({tuple(x) for x in got.collect()} if SHAPES[shape][0].free else ({()} if got.first()[0] else set())) == want
    assert {tuple(x) for x in search.by_search(db, *SHAPES[shape]).collect()} == ({tuple(x) for x in want} if SHAPES[shape][0].free else {(bool(want),)})


def test_ranges_of_random_joins(spark):
    r = random.Random(5)
    rows = {"r": [(r.randrange(4), r.randrange(3), r.randrange(9)) for _ in range(8)], "s": [(r.randrange(3), r.randrange(2)) for _ in range(5)]}
    db = Database().register("r", spark.createDataFrame(rows["r"], "a int, b int, v int"), ["a"])
    db.register("s", spark.createDataFrame(rows["s"], "c int, d int"), ["c"])
    worlds = []
    for k in repairs(rows, {"r": 1, "s": 1}):
        own = {}
        for _, b, v in k["r"]:
            for c, d in k["s"]:
                if b == c:
                    own.setdefault(d, []).append(v)
        worlds.append(own)
    sure = set.intersection(*map(set, worlds))
    of = lambda f, g: tuple(m(f(w[g]) for w in worlds) for m in (min, max))
    want = {g: (*of(len, g), *of(sum, g), *of(min, g), *of(max, g)) for g in sure}
    q = Query(("g",), (atom("r", a="x", b="y", v="v"), atom("s", c="y", d="g")))
    assert {x.g: tuple(x)[1:] for x in Engine(db).ranges(q, "v").collect()} == want
    assert {x.g: tuple(x)[1:] for x in search.extremes_by_search(db, q, "v").collect()} == {g: w[4:] for g, w in want.items()}
    assert {x.g: (x.glb, x.lub) for x in search.ranges_by_search(db, q, "v").collect()} == {g: w[2:4] for g, w in want.items()}
    assert {x.g: (x.glb, x.lub) for x in search.ranges_by_search(db, q).collect()} == {g: w[:2] for g, w in want.items()}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 1), (None, 2), (1, None), (1, None), (2, 5), (3, 5), (3, None)]
    db = Database().register("r", spark.createDataFrame(rows, "a int, b int"), ["a"])
    e = Engine(db)
    q = Query(("x",), (atom("r", "b > 0", a="x"),))
    for strategy in ("division", "blocks", "search"):
        assert values(e.certain(q, strategy=strategy)) == {None, 2}
    empty = Database().register("r", spark.createDataFrame([], "a int, b int"), ["a"])
    assert Engine(empty).certain(q).count() == 0 and Engine(empty).certain(q, strategy="search").count() == 0
    assert not Engine(empty).ranges(Query((), (atom("r", b="v"),)), "v").first().cons_answer
    with pytest.raises(ValueError, match="key"):
        Database().register("r", spark.createDataFrame([], "a int"), ["z"])


def test_denials(spark):
    rows = [(1, 5.0), (1, 7.0), (2, 3.0), (3, -1.0), (4, 9.0), (4, 9.5), (4, 10.0)]
    one = Denial((("a", "p"), ("b", "p")), "a.id = b.id AND a.id = 1 AND a.w <> b.w", symmetric=True)
    low = Denial((("a", "p"),), "a.w < 0")
    three = Denial((("a", "p"), ("b", "p"), ("c", "p")), "a.id = 4 AND b.id = 4 AND c.id = 4 AND a.w < b.w AND b.w < c.w")
    db = Database(denials=[one, low, three]).register("p", spark.createDataFrame(rows, "id int, w double"), ["id"])
    assert sorted(len(x.facts) for x in denial.all_violations(db).collect()) == [1, 2, 3]
    assert values(denial.in_every_repair(db, "p")) == {(2, 3.0)}
    assert values(denial.certain_values(db, "p", ["id"])) == {1, 2, 4}
    assert values(denial.certain_values(db, "p", ["id", "w"])) == {(2, 3.0)}


def largest_without(facts, conflicts):
    free = [frozenset(s) for n in range(len(facts) + 1) for s in itertools.combinations(sorted(facts), n) if not any(c <= set(s) for c in conflicts)]
    return [s for s in free if not any(s < t for t in free)]


def test_witnesses_that_repairs_avoid():
    r = random.Random(3)
    for _ in range(300):
        facts = {f"f{i}" for i in range(r.randrange(2, 8))}
        conflicts = [frozenset(r.sample(sorted(facts), r.choice([2, 2, 3]) if len(facts) > 2 else 2)) for _ in range(r.randrange(1, 7))]
        conflicts = [c for c in set(conflicts) if not any(o < c for o in conflicts)]
        touched = sorted(set().union(*conflicts))
        ws = [frozenset(r.sample(touched, r.randrange(1, min(3, len(touched)) + 1))) for _ in range(r.randrange(1, 5))]
        want = any(not any(w <= s for w in ws) for s in largest_without(facts, conflicts))
        assert denial.avoidable(ws, conflicts) == want


def test_long_rows_of_conflicts():
    pairs = [frozenset({i, i + 1}) for i in range(3000)]
    assert not denial.avoidable([frozenset({0}), frozenset({1})], pairs)
    assert denial.avoidable([frozenset({i}) for i in range(0, 3000, 2)], pairs)
    star = [frozenset({0, i}) for i in range(1, 3000)]
    assert denial.avoidable([frozenset({i}) for i in range(1, 3000)], star) and not denial.avoidable([frozenset({0}), frozenset({1})], star)


def worlds_under(rows, denials):
    """Largest sets of rows, named by table and row, that no denial forbids; a denial is a test of sets of rows."""
    every = [(t, x) for t, own in rows.items() for x in own]
    free = [frozenset(s) for n in range(len(every) + 1) for s in itertools.combinations(every, n) if not any(d(s) for d in denials)]
    return [s for s in free if not any(s < t for t in free)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_answers_under_denials(spark, seed):
    r = random.Random(seed)
    rows = {"p": list({(r.randrange(3), r.randrange(4)) for _ in range(6)}), "s": list({(r.randrange(4), r.randrange(3)) for _ in range(4)})}
    agree = agreeing("p", ["a"], "b")
    across = Denial((("x", "p"), ("y", "s")), "x.b = y.c AND x.a > y.d")
    three = Denial((("x", "p"), ("y", "p"), ("z", "s")), "x.a < y.a AND z.c = 1")
    tests = [
        lambda k: any(x[0] == y[0] and x[1] != y[1] for t, x in k for u, y in k if t == u == "p"),
        lambda k: any(x[1] == y[0] and x[0] > y[1] for t, x in k for u, y in k if t == "p" and u == "s"),
        lambda k: any(x[0] < y[0] and z[0] == 1 for t, x in k for u, y in k for v, z in k if t == u == "p" and v == "s"),
    ]
    db = Database(denials=[agree, across, three]).register("p", spark.createDataFrame(rows["p"], "a int, b int"), ["a"])
    db.register("s", spark.createDataFrame(rows["s"], "c int, d int"), ["c"])
    worlds = worlds_under(rows, tests)
    joins = [{(x[0], y[1]) for t, x in k for u, y in k if t == "p" and u == "s" and x[1] == y[0]} | {(x[0], 0) for t, x in k if t == "p" and x[1] > 1 for y in [0]} for k in worlds]
    join = Query(("a", "d"), (atom("p", a="a", b="b"), atom("s", c="b", d="d")))
    high = Query(("a", "d"), (atom("p", "b > 1", a="a"), atom("zero", z="d")))
    db.register("zero", spark.createDataFrame([(0,)], "z int"), ["z"])
    assert values(denial.certain_answers(db, join, high)) == set.intersection(*joins)
    assert values(denial.certain_values(db, "p", ["b"])) == set.intersection(*[{x[1] for t, x in k if t == "p"} for k in worlds])
    assert values(denial.in_every_repair(db, "s")) == {x for x in rows["s"] if all(("s", x) in k for k in worlds)}


def test_agreement_by_classes(spark):
    rows = [(1, "a", 5), (1, "a", 6), (1, "b", 5), (2, "a", 7), (3, None, 8), (3, "a", 9), (None, "a", 1), (None, "b", 2), (4, "a", -1), (4, "b", 3), (1, "b", 5)]
    db = Database(denials=[agreeing("p", ["k"], "v"), Denial((("x", "p"),), "x.w < 0")]).register("p", spark.createDataFrame(rows, "k int, v string, w int"), ["k"])
    assert values(denial.in_every_repair(db, "p")) == {(2, "a", 7), (3, None, 8), (3, "a", 9), (None, "a", 1), (None, "b", 2), (4, "b", 3)}
    assert values(denial.certain_values(db, "p", ["w"])) == {5, 7, 8, 9, 1, 2, 3}
    assert values(denial.conflict_counts(db, db.denials[0])) == {(1, 2), (4, 1)}
    assert {len(x.facts) for x in denial.all_violations(db).collect()} == {1, 2}


def test_smallest_violations_of_any_size(spark):
    same = " AND ".join(f"{x}.id < {y}.id" for x, y in zip("abc", "bcd", strict=True))
    three = Denial(tuple((x, "p") for x in "abc"), "a.id = 1 AND b.id = 2 AND c.id = 3")
    four = Denial(tuple((x, "p") for x in "abcd"), same)
    db = Database(denials=[three, four]).register("p", spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int"), ["id"])
    assert [len(x.facts) for x in denial.all_violations(db).collect()] == [3]
    assert values(denial.in_every_repair(db, "p")) == {4}


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_elimination_against_all_picks(monkeypatch, cells):
    monkeypatch.setattr(elimination, "CELLS", cells)
    r = random.Random(cells)
    for _ in range(200):
        n = r.randrange(1, 6)
        sizes = {b: r.randrange(2, 4) for b in range(n)}
        ws = [({b: r.randrange(sizes[b]) for b in r.sample(range(n), r.randrange(1, min(3, n) + 1))}, float(r.randrange(-4, 6))) for _ in range(r.randrange(1, 9))]
        kept = [[v for w, v in ws if all(p[b] == f for b, f in w.items())] for p in itertools.product(*[range(k) for k in sizes.values()])]
        assert elimination.least(ws, sizes, elimination.SUM) == min(map(sum, kept))
        assert elimination.least(ws, sizes, elimination.TOP) == min(max(k, default=-elimination.inf) for k in kept)
        assert elimination.breakable([w for w, _ in ws], sizes) == ([] in kept)
        assert {frozenset(w.items()) for w in elimination.minimal([w for w, _ in ws])} == {frozenset(w.items()) for w, _ in ws if not any(o.items() < w.items() for o, _ in ws)}


def test_large_components():
    n = 10_000
    path = [({i: 0, i + 1: 1}, 1.0) for i in range(n)]
    tree = [({i: 0, (i - 1) // 2: 1}, 1.0) for i in range(1, n)]
    star = [({0: i % 3000, i: 0}, 1.0) for i in range(1, n)]
    for ws, most in ((path, n // 2), (tree, None), (star, 4)):
        sizes = {b: 3000 if ws is star and b == 0 else 2 for w, _ in ws for b in w}
        assert elimination.least(ws, sizes, elimination.SUM) == 0 and elimination.breakable([w for w, _ in ws], sizes)
        high = -elimination.least([(w, -v) for w, v in ws], sizes, elimination.SUM)
        assert high == most if most else high > n // 2
    sure = [{i: 1, i + 1: 0} for i in range(n)] + [{0: 0}, {n: 1}]
    assert not elimination.breakable(sure, {i: 2 for i in range(n + 1)})


@pytest.mark.parametrize("few", [0, 1000])
def test_many_witnesses_of_one_answer(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    rows = [(i, j) for i in range(60) for j in (i, i + 1)]
    db = Database().register("r", spark.createDataFrame(rows, "a int, b int"), ["a"])
    db.register("s", spark.createDataFrame([(b, d) for b in range(61) for d in (0, 1)], "c int, d int"), ["c"])
    q = Query((), (atom("r", a="x", b="y"), atom("s", "d = 1", c="y")))
    assert tuple(search.ranges_by_search(db, q).collect()) == () and not search.by_search(db, q).first()[0]
    more = Query((), (atom("r", a="x", b="y"), atom("s", "c < 30 or d = 1", c="y", d="d")))
    got = search.all_ranges(db, more, "d").first()
    assert (got.count_glb, got.count_lub, got.sum_glb, got.sum_lub, got.min_glb, got.min_lub, got.max_glb, got.max_lub) == (29, 60, 0, 60, 0, 1, 0, 1)


CLASHING = ["value", "answer", "n0", "k0_0", "fact", "block", "node", "whole", "dirty"]


@pytest.mark.parametrize("names", [CLASHING[i : i + 3] for i in range(0, len(CLASHING), 3)])
def test_names_that_operators_might_use(spark, names):
    x, y, z = names
    emp = spark.createDataFrame(EMP, f"{x} int, {y} string, {z} int")
    db = Database(denials=[Denial((("a", "emp"),), f"a.{z} < 0"), agreeing("emp", [x], y)])
    db.register("emp", emp, [x]).register("dept", spark.createDataFrame(DEPT, f"{y} string, {z} string"), [y])
    q = Query((x, z), (Atom("emp", ((x, x), (y, y))), Atom("dept", ((y, y), (z, z)))))
    for strategy in ("division", "blocks", "search"):
        assert values(Engine(db).certain(q, strategy=strategy)) == {(1, "NY"), (2, "NY"), (4, "NY")}, strategy
    assert values(Engine(db).certain(q, q)) == {(1, "NY"), (2, "NY"), (4, "NY")}
    counted = Query((y,), (Atom("emp", ((x, x), (y, y), (z, z))),))
    want = {"toys": (20, 30), "books": (-5, 15), "games": (30, 35)}
    if y not in ("glb", "lub"):
        assert {r[0]: (r.sum_glb, r.sum_lub) for r in Engine(db).ranges(counted, z).collect()} == want
        assert {r[0]: (r.sum_glb, r.sum_lub) for r in search.all_ranges(db, counted, z).collect()} == want
    assert values(denial.certain_values(db, "emp", [x])) == {1, 2, 3, 4} and values(certain.relevant_facts(db, q, 0)) == {(1, "toys"), (1, "books")}


def test_reserved_and_alike_names(spark):
    with pytest.raises(ValueError, match="reserved"):
        Query(("__certus_n0",), (atom("r", a="__certus_n0"),))
    with pytest.raises(ValueError, match="case"):
        Query(("x",), (atom("r", a="x", b="X"),))
    with pytest.raises(ValueError, match="reserved"):
        Database().register("r", spark.createDataFrame([], "a int, __CERTUS_x int"), ["a"])
    db = Database().register("r", spark.createDataFrame([(1, 5)], "a int, v int"), ["a"])
    assert values(Engine(db).certain(Query(("x",), (atom("r", "V > 0", A="x"),)))) == {1}
    with pytest.raises(ValueError, match="results"):
        Engine(db).ranges(Query(("sum_glb",), (atom("r", a="sum_glb", v="v"),)), "v")


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_roots_are_found(company, order):
    """The same forest, whatever the order of its atoms; a second tree shares nothing with the first."""
    atoms = (WORKS[0], WORKS[1], atom("dept", "city <> 'LA'", dept="other"))
    db = Database(dict(company.tables)).register("place", company.tables["dept"].frame, ["dept"])
    atoms = (*atoms[:2], atom("place", "city <> 'LA'", dept="other"))
    q = Query(("id", "other"), tuple(atoms[i] for i in order))
    want = {(i, d) for i in (1, 2, 4) for d in ("toys", "books")} | {(3, d) for d in ("toys", "books")}
    for strategy in ("auto", "blocks", "search"):
        assert values(Engine(db).certain(q, strategy=strategy)) == want, strategy
    two = Query(("city",), tuple(atom("emp", id="id", dept="d", sal="v") if i == 0 else atoms[1] for i in order if i < 2))
    assert {r.city: (r.count_glb, r.count_lub) for r in Engine(db).ranges(two, "v").collect()} == {"NY": (3, 3)}


def test_relevant_and_witnesses(company):
    q = Query(("city",), WORKS)
    assert certain.witnesses(company, q).count() == 6
    got = {(r.id, r.dept) for r in certain.relevant_facts(company, q, 0).collect()}
    assert got == {(1, "toys"), (1, "books")}


@pytest.mark.parametrize("seed", [3, 8])
def test_extremes_of_a_hard_pattern(spark, seed):
    r = random.Random(seed)
    rows = {"r": [(r.randrange(3), r.randrange(3), r.randrange(-5, 9)) for _ in range(6)] + [(9, 1, 2)], "s": [(r.randrange(3), r.randrange(3)) for _ in range(4)] + [(9, 1)]}
    db = Database().register("r", spark.createDataFrame(rows["r"], "a int, b int, v int"), ["a"])
    db.register("s", spark.createDataFrame(rows["s"], "c int, d int"), ["c"])
    worlds = [[v for _, b, v in k["r"] for _, d in k["s"] if b == d] for k in repairs(rows, {"r": 1, "s": 1})]
    low, high = [min(w) for w in worlds], [max(w) for w in worlds]
    q = Query((), (atom("r", a="x", b="z", v="v"), atom("s", c="y", d="z")))
    assert tuple(search.extremes_by_search(db, q, "v").first()) == (min(low), max(low), min(high), max(high))

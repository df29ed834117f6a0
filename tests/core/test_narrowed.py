"""Of answers that hold a key, only those that a look at their own witnesses leaves open are kept for the search."""

import itertools
import random

import pytest

from certus.operators import blocks, search
from certus.plans.query import Database, Query, atom

JOINED = Query(("x", "z"), (atom("r", a="x", b="y"), atom("s", "d > 0", c="y", d="z")))
OWN = Query(("x", "z"), (atom("r", a="x", b="y"), atom("s", c="x", d="z")))
SELF = Query(("x", "z"), (atom("r", a="x", b="y"), atom("r", "b > 0", a="y", b="z")))


def kept_in(rows):
    """All ways to keep one row of each block."""
    by = {}
    for r in dict.fromkeys(rows):
        by.setdefault(r[0], []).append(r)
    return itertools.product(*by.values())


def worlds(r_rows, s_rows, queries):
    for r, s in itertools.product(kept_in(r_rows), kept_in(s_rows)):
        out = set()
        for q in queries:
            same = lambda u, v: u is not None and u == v
            if q is JOINED:
                out |= {(x, z) for x, y in r for c, z in s if same(y, c) and z is not None and z > 0}
            elif q is OWN:
                out |= {(x, z) for x, _ in r for c, z in s if same(x, c)}
            else:
                out |= {(x, z) for x, y in r for a, z in r if same(y, a) and z is not None and z > 0}
        yield out


@pytest.mark.parametrize("queries", [(JOINED,), (SELF,), (JOINED, OWN)], ids=["join", "self", "union"])
def test_as_by_all_repairs(spark, monkeypatch, queries):
    monkeypatch.setattr(blocks, "ROWS", 3)
    pick = random.Random(len(queries))
    for _ in range(2):
        make = lambda: [(pick.choice([0, 1, 2, 3, None]), pick.choice([0, 1, 2, 2, None])) for _ in range(9)]
        r, s = make(), make()[:7]
        db = Database().register("r", spark.createDataFrame(r, "a int, b int"), ["a"]).register("s", spark.createDataFrame(s, "c int, d int"), ["c"])
        assert sorted(map(repr, map(tuple, search.by_search(db, *queries).collect()))) == sorted(map(repr, set.intersection(*worlds(r, s, queries))))


def test_settled_answers_are_not_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(search, "saved", lambda df: kept.append(df.count()) or df)
    r = [(1, 1), (2, 2), (3, 1), (3, 2), (4, 1), (4, 3), (5, 4)]
    s = [(1, 7), (2, 7), (3, 8), (4, 8), (4, 9)]  # 1 to 3 are certain, 4 has no row for 7 or 8 alone, 5 neither
    db = Database().register("r", spark.createDataFrame(r, "a int, b int"), ["a"]).register("s", spark.createDataFrame(s, "c int, d int"), ["c"])
    assert sorted(map(tuple, search.by_search(db, JOINED).collect())) == [(1, 7), (2, 7), (3, 7)]
    assert not any(kept)


def test_blocks_that_only_look_alike(spark):
    """Keys that are equal to a variable of another type are blocks of their own."""
    q = Query(("x", "y"), (atom("s", c="x"), atom("r", a="x", b="y")))
    rows = [("01", 5), ("01", 6), ("1", 5), ("02", 5), ("02", 6), ("2", 5), ("2", 6)]
    db = Database().register("s", spark.createDataFrame([(1,), (2,)], "c int"), ["c"]).register("r", spark.createDataFrame(rows, "a string, b int"), ["a"])
    assert [(int(x.x), x.y) for x in search.by_search(db, q).collect()] == [(1, 5)]

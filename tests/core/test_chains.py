"""Violations of chains, counted without being written out."""

import random

import pytest

from certus.operators import denial
from certus.plans.query import Database, Denial, chained

ROWS = "id long, g long, v double, w long"
FAMILIES = [
    [chained("t", [], ["{r}.w = 0"]), chained("t", ["g"], ["{r}.v > 4"] * 2), chained("t", ["g"], ["{r}.v > 1", "true", "{r}.w > 1"], "v")],
    [chained("t", ["g"], ["{r}.w = 1", "{r}.w = 2"], "v"), chained("t", ["g"], ["{r}.v < 4", "{r}.w <> 3"], "v"), chained("t", ["g"], ["true", "{r}.w > 0", "true"], "v")],
    [chained("t", ["g"], ["{r}.w = 3"] * 3), chained("t", ["g"], ["{r}.w >= 2"] * 3), chained("t", ["g"], ["true"] * 4, "v")],
    [chained("t", [], ["{r}.w = 0"]), chained("t", [], ["{r}.v > 6"])],
    [chained("t", ["g"], ["true"] * 2, "v"), chained("t", ["g"], ["{r}.w = 1"] * 3)],  # not counted by sums
    [chained("t", ["g"], ["{r}.v > 3"] * 2), Denial((("a", "t"), ("b", "t")), "a.g < b.g AND a.v = b.v")],
]


def counts(df):
    return {r.n_rows: r.n_violations for r in df.collect()}


@pytest.mark.parametrize("family", range(len(FAMILIES)))
def test_as_many_as_are_written_out(spark, family):
    rng = random.Random(family)
    odd = lambda x: None if rng.random() < 0.1 else x
    rows = [(i, odd(rng.randrange(3)), odd(rng.choice([0.0, -0.0, 1.0, 2.0, 3.5, 5.0, 5.0, 7.0, float("nan")])), odd(rng.randrange(4))) for i in range(36)]
    db = Database(denials=FAMILIES[family]).register("t", spark.createDataFrame(rows + rows[:9], ROWS), ["id"])
    written = denial.all_violations(db).selectExpr("size(facts) AS n_rows").groupBy("n_rows").count().collect()
    assert counts(denial.violation_counts(db)) == {r.n_rows: r["count"] for r in written}
    assert denial.countable(db.denials) == (family < 4)


def test_billions_of_violations(spark):
    n = 6000
    db = Database(denials=[chained("t", ["g"], ["true"] * 3, "id")]).register("t", spark.range(n).selectExpr("id", "0 AS g"), ["id"])
    assert counts(denial.violation_counts(db)) == {3: n * (n - 1) * (n - 2) // 6}


def test_rows_without_an_order_have_one_condition():
    with pytest.raises(ValueError):
        chained("t", ["g"], ["{r}.v > 1", "{r}.v > 2"])

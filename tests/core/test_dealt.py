"""Large tables are dealt to as many tasks as their rows ask for, with the same results."""

import pytest
from pyspark.sql import Row

from certus.engine import Engine
from certus.operators import blocks, search
from certus.operators.components import connected_components
from certus.plans.query import Database, Query, atom

JOINED = Query(("o", "l", "b"), (atom("line", "q > 2", o="o", l="l", p="p"), atom("part", "size > 1", p="p", brand="b")))
SINGLE = Query(("o", "l", "f"), (atom("line", "q > 2", o="o", l="l", f="f"),))
BY_BRAND = Query(("b",), (atom("line", "q > 2", p="p", q="v"), atom("part", "size > 1", p="p", brand="b")))


def company(spark):
    line = spark.range(900).selectExpr("id * 7 % 211 AS o", "id % 3 AS l", "id * 31 % 40 AS p", "CAST(id * 13 % 11 AS double) AS q", "if(id % 17 = 0, null, id % 2) AS f")
    part = spark.range(60).selectExpr("id % 45 AS p", "concat('b', id % 4) AS brand", "id % 7 AS size")
    return Database().register("line", line, ["o", "l"]).register("part", part, ["p"])


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("what", ["blocks", "division", "clean", "suspect", "range"])
def test_same_results(spark, monkeypatch, what):
    def run():
        e = Engine(company(spark))
        if what == "suspect":
            return rows(e.suspect(SINGLE)), rows(e.suspect(JOINED))
        if what == "range":
            return rows(e.ranges(BY_BRAND, "v"))
        return rows(e.certain(SINGLE, strategy=what)), rows(e.certain(JOINED, strategy=what))

    plain = run()
    monkeypatch.setattr(blocks, "ROWS", 100)
    assert run() == plain


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 50)
    e = Engine(company(spark))
    for df in (blocks.with_size(e.db.tables["line"]), e.certain(JOINED), e.certain(SINGLE), e.suspect(SINGLE)):
        assert df.rdd.getNumPartitions() >= 18


OTHER = Query(("o", "l"), (atom("line", "f = 1", o="o", l="l"),))
BY_FLAG = Query(("f",), (atom("line", "q > 2", f="f", q="v"),))


def test_searches_are_dealt_by_rows(spark, monkeypatch):
    """With the same results; witnesses without larger ones beside them aren't handed to Python."""

    def run():
        db = company(spark)
        e = Engine(db)
        union = e.certain(Query(("o", "l"), SINGLE.atoms), OTHER)
        return union, rows(union), rows(e.certain(JOINED, strategy="search")), rows(e.certain(SINGLE, strategy="search")), rows(search.all_ranges(db, BY_FLAG, "v")), rows(search.all_ranges(db, BY_BRAND, "v"))

    plain = run()
    for few in (search.FEW, 3):  # 3: groups of witnesses are found by components
        monkeypatch.setattr(blocks, "ROWS", 50)
        monkeypatch.setattr(search, "FEW", few)
        found = run()
        assert found[1:] == plain[1:]
        assert found[0].rdd.getNumPartitions() >= 18
    assert rows(Engine(company(spark)).certain(SINGLE, strategy="blocks")) == plain[3]
    assert "MapInArrow" not in found[0]._jdf.queryExecution().toString()


def test_steps_of_components_are_dealt_by_links(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 50)
    links = spark.range(400).selectExpr("id AS a", "id + if(id % 10 = 9, 0, 1) AS b")
    found = connected_components(links, 400)
    assert found.rdd.getNumPartitions() >= 8
    assert rows(found) == sorted(repr(Row(node=i, root=i - i % 10)) for i in range(400) if i % 10)

"""Sources, blocks, injected and generated inconsistency, time limits and the stream of violations."""

import time

import pytest
from pyspark.sql import functions as F

from certus.engine import Engine
from certus.functions.storage import within
from certus.operators import blocks
from certus.operators.generator import block_count, chain, for_query, generated
from certus.operators.injector import injected, ranked
from certus.plans.query import Query, Table, atom
from certus.sources.tables import declared_keys, delimited, preview, previews
from certus.streaming.blocks import violating_keys


def test_delimited_and_preview(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|a|2.5\n2|b|\n")
    df = delimited(spark, str(tmp_path / "t.tbl"), "id int, name string, v double")
    assert preview(df, 1) == {"columns": ["id", "name", "v"], "data": [{"id": 1, "name": "a", "v": 2.5}], "row_count": 2}
    assert preview(df, 1, once=True) == preview(df, 1)


def test_declared_keys(spark):
    rows = [(1, "Primary Key", "PARTSUPP(PS_PARTKEY,PS_SUPPKEY)"), (2, "Denial Constraint", "x"), (3, "primary key", "R(A)")]
    assert declared_keys(spark.createDataFrame(rows, "constraint_id int, constraint_type string, constraint_definition string")) == {"PARTSUPP": ["PS_PARTKEY", "PS_SUPPKEY"], "R": ["A"]}


def test_blocks(spark):
    t = Table(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, v string"), ("k",))
    assert {tuple(r) for r in blocks.violating_keys(t).collect()} == {(2, 2), (None, 2)}
    assert {tuple(r) for r in blocks.clean_part(t).collect()} == {(1, "a")}
    assert blocks.dirty_part(t).count() == 4
    assert {tuple(r) for r in blocks.histogram(t).collect()} == {(1, 1), (2, 2)}


def test_one_shuffle_serves_the_block_test(spark):
    t = Table(spark.range(100).select((F.col("id") % 40).alias("k"), "id"), ("k",))
    plan = blocks.with_size(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_injected_blocks(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7).alias("v"))
    out = injected(df, ["id"], 10)
    x = 10 * 3000 // (2700 - 210)
    sizes = {r["n"]: r["blocks"] for r in out.groupBy("id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("blocks")).collect()}
    assert sizes == {1: 3000 - 6 * x, **{s: x for s in range(2, 8)}}
    assert out.dropDuplicates().count() == out.count()
    assert [r["rank"] for r in ranked(df, ["id"]).orderBy("rank").select("rank").collect()] == list(range(3000))
    assert injected(df.limit(5), ["id"]).count() == 5


def test_stream(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:01"), (2, "c", "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "k int, v string, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = violating_keys(stream, ["k"], "t", "1 minute").writeStream.outputMode("update").format("memory").queryName("bad").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from bad").collect()} == {(2, 2)}


def test_generated(spark):
    df = generated(spark, 1000, 50, percent=12, group=3, joined=40)
    sizes = {r["n"]: r["blocks"] for r in df.groupBy("key").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("blocks")).collect()}
    assert sizes == {1: 880, 3: 40} and sum(sizes.values()) == block_count(1000, 12, 3)
    assert df.where("ref < 50").count() == 400
    assert df.select("value").distinct().count() == 1000
    assert generated(spark, 0, 0).count() == 0
    found = previews(chain(spark, 2, 30), 3)
    assert list(found) == ["r1", "r2"] and found["r2"]["row_count"] == 30 and len(found["r1"]["data"]) == 3


def test_generated_for_a_query(spark):
    q = Query(("x",), (atom("r", a="x", b="y"), atom("s", c="y", d="z")))
    db = for_query(spark, q, {"r": ["a"], "s": ["c"]}, 1000, joined=40, dirty=12, sizes=(2, 3, 5))
    assert Engine(db).possible(q).count() >= 400
    sizes = {r["block_size"]: r["n_blocks"] for r in blocks.histogram(db.tables["s"]).collect()}
    assert set(sizes) == {1, 2, 3, 5} and sum(sizes.values()) == 1000 and sizes[1] == 1000 - sum(sizes[k] for k in (2, 3, 5))
    assert for_query(spark, q, {"r": ["a"], "s": ["c"]}, 0).tables["r"].frame.count() == 0
    with pytest.raises(ValueError, match="own"):
        for_query(spark, Query((), (q.atoms[0], q.atoms[0])), {"r": ["a"]}, 5)


def test_time_limit(spark):
    assert within(spark.range(5), 60).count() == 5
    slow = spark.range(0, 4, 1, 4).mapInPandas(lambda batches: ((time.sleep(30), b)[1] for b in batches), "id long")
    began = time.time()
    with pytest.raises(TimeoutError):
        within(slow, 2)
    assert time.time() - began < 25
    assert spark.range(5).count() == 5

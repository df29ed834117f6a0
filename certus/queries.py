"""Registered queries over the TPC-H-like tables, and the SQL they are held against.

lineitem violates its key (l_orderkey, l_linenumber) as it comes. Parents are
made inconsistent by re-keying some of their rows, the same way in both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.engine import Engine
from certus.functions.storage import shared_dir
from certus.operators import blocks, certain, denial, search
from certus.operators.generator import chain, for_query
from certus.operators.injector import injected, ranked
from certus.plans.analyze import report
from certus.plans.query import Database, Denial, Query, Table, agreeing, atom, chained
from certus.sources.tables import declared_keys, delimited, parquet, previews

LINE_KEY = ["l_orderkey", "l_linenumber"]
PART_KEY = "CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 1 ELSE p_partkey END"
ORDER_KEY = "CASE WHEN o_orderkey % 20 = 19 THEN o_orderkey - 1 ELSE o_orderkey END"

Run = Callable[[SparkSession, str], DataFrame]


def tables(spark: SparkSession, sf_dir: str) -> Database:
    """lineitem as it is, part and orders re-keyed, customer and supplier with declared keys."""
    read = lambda name: parquet(spark, sf_dir, name)
    db = Database()
    db.register("lineitem", read("lineitem"), LINE_KEY)
    db.register("part", read("part").withColumn("p_partkey", F.expr(PART_KEY)), ["p_partkey"])
    db.register("orders", read("orders").withColumn("o_orderkey", F.expr(ORDER_KEY)), ["o_orderkey"])
    db.register("customer", read("customer"), ["c_custkey"])
    db.register("supplier", read("supplier"), ["s_nationkey"])
    db.register("nation", read("nation"), ["n_nationkey"])
    return db


def lineitem(spark: SparkSession, sf_dir: str) -> Table:
    return tables(spark, sf_dir).tables["lineitem"]


LINES = Query(("l_orderkey", "l_linenumber", "l_returnflag"), (atom("lineitem", "l_quantity > 10", l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_returnflag="l_returnflag"),))
SUPPLIERS = Query(("l_suppkey",), (atom("lineitem", "l_quantity > 45", l_suppkey="l_suppkey"),))
BRANDS = Query(
    ("l_orderkey", "l_linenumber", "p_brand"),
    (atom("lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_partkey="p"), atom("part", "p_size > 5", p_partkey="p", p_brand="p_brand")),
)
SEGMENTS = Query(
    ("l_orderkey", "l_linenumber", "c_mktsegment"),
    (
        atom("lineitem", "l_quantity > 5", l_orderkey="l_orderkey", l_linenumber="l_linenumber"),
        atom("orders", "o_orderstatus <> 'P'", o_orderkey="l_orderkey", o_custkey="c"),
        atom("customer", c_custkey="c", c_mktsegment="c_mktsegment"),
    ),
)
ANY = Query((), (atom("lineitem", "l_quantity > 49 AND l_returnflag = 'R'"),))
ANY_BRAND = Query((), (atom("lineitem", "l_quantity > 49", l_partkey="p"), atom("part", "p_brand = 'Brand#11'", p_partkey="p")))
FLAGGED = Query(("l_orderkey", "l_linenumber"), (atom("lineitem", "l_returnflag = 'A'", l_orderkey="l_orderkey", l_linenumber="l_linenumber"),))
OPEN = Query(("l_orderkey", "l_linenumber"), (atom("lineitem", "l_linestatus = 'O'", l_orderkey="l_orderkey", l_linenumber="l_linenumber"),))
NATIONS = Query(
    ("n_name",),
    (atom("supplier", "s_acctbal > 0", s_nationkey="n"), atom("nation", n_nationkey="n", n_name="n_name")),
)
QUANTITIES = Query((), (atom("lineitem", "l_returnflag = 'R'", l_quantity="v"),))
BY_FLAG = Query(("l_returnflag",), (atom("lineitem", "l_quantity > 10", l_returnflag="l_returnflag", l_quantity="v"),))
BY_BRAND = Query(("p_brand",), (atom("lineitem", "l_quantity > 10", l_partkey="p", l_quantity="v"), atom("part", "p_size > 5", p_partkey="p", p_brand="p_brand")))
#: Two lines of one order, each in its block, with the same supplier.
TWINS = Query(
    ("o",),
    (atom("lineitem", "l_linenumber = 1", l_orderkey="o", l_suppkey="s"), atom("lineitem", "l_linenumber = 2", l_orderkey="o", l_suppkey="s")),
)


#: Two tables that refer to each other.
LOOP = Query((), (atom("r1", key="x", ref="y"), atom("r2", key="y", ref="x")))
#: Flags of lines by the orders that keep them, with values on both sides of zero.
BY_KEPT = Query(("l_returnflag",), (atom("lineitem", l_orderkey="o", l_returnflag="l_returnflag", v="v"), atom("orders", "o_orderstatus <> 'P'", o_orderkey="o")))
#: The same as BRANDS and SEGMENTS, with the roots not first and an atom apart.
FOREST = Query(("l_orderkey", "l_linenumber", "p_brand", "n_name"), (atom("nation", n_nationkey="n", n_name="n_name"), BRANDS.atoms[1], atom("supplier", "s_acctbal > 0", s_nationkey="n"), BRANDS.atoms[0]))
#: Rows of r1 that lead on to r3 in every repair.
PATH = Query(("x",), (atom("r1", key="x", ref="y"), atom("r2", key="y", ref="z"), atom("r3", key="z")))


#: How many rows of r1 lead on to r3, all in all.
REACHED = Query((), PATH.atoms)


def generated_brands(spark: SparkSession, sf_dir: str) -> Database:
    """Relations made for BRANDS, with blocks of up to four rows."""
    return for_query(spark, BRANDS, {"lineitem": LINE_KEY, "part": ["p_partkey"]}, parquet(spark, sf_dir, "orders").count(), sizes=(2, 3, 4))


def generated_chain(spark: SparkSession, sf_dir: str) -> Database:
    """Three generated relations, each with as many rows as orders."""
    return chain(spark, 3, parquet(spark, sf_dir, "orders").count(), joined=60)


def cents(df: DataFrame) -> DataFrame:
    """Sums rounded as in the SQL."""
    return df.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def status_denial() -> Denial:
    """One customer's orders all have one status."""
    return agreeing("orders", ["o_custkey"], "o_orderstatus")


def order_denials(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(denials=[status_denial(), Denial((("a", "orders"),), "a.o_totalprice < 1500")])
    return db.register("orders", parquet(spark, sf_dir, "orders"), ["o_orderkey"])


#: What no suppliers of one nation may have: one alone, two or three together.
SUPPLIER_DENIALS = [
    chained("supplier", [], ["{r}.s_acctbal < -800"]),
    chained("supplier", ["s_nationkey"], ["{r}.s_acctbal > 8000"] * 2),
    chained("supplier", ["s_nationkey"], ["{r}.s_acctbal > 5000", "true", "true"], "s_acctbal"),
]


def smallest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of violations of each size that hold no smaller one."""
    db = Database(denials=SUPPLIER_DENIALS).register("supplier", parquet(spark, sf_dir, "supplier"), ["s_suppkey"])
    return denial.violation_counts(db)


#: Priorities of a customer's orders: of any, if the customer is kept, or of big ones.
KEPT = Query(("c", "p"), (atom("orders", o_custkey="c", o_orderpriority="p"), atom("customer", c_custkey="c")))
BIG = Query(("c", "p"), (atom("orders", "o_totalprice > 200000", o_custkey="c", o_orderpriority="p"),))


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain priorities where a customer in debt and a big order of theirs exclude each other."""
    debt = Denial((("o", "orders"), ("c", "customer")), "o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 AND c.c_acctbal < 0")
    db = Database(denials=[debt]).register("orders", parquet(spark, sf_dir, "orders"), ["o_orderkey"])
    db.register("customer", parquet(spark, sf_dir, "customer"), ["c_custkey"])
    return denial.certain_answers(db, KEPT, BIG)


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        n = parquet(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionAll(n)
    return out


def shifted(spark: SparkSession, sf_dir: str) -> Database:
    """The tables with v, the quantity less 25, in lineitem."""
    db = tables(spark, sf_dir)
    return db.register("lineitem", db.tables["lineitem"].frame.withColumn("v", F.col("l_quantity") - 25), LINE_KEY)


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analyser says of four queries, as rows."""
    db = generated_chain(spark, sf_dir)
    for name, table in tables(spark, sf_dir).tables.items():
        db.tables[name] = table
    rows = [(name, *r) for name, q in (("segments", SEGMENTS), ("path", PATH), ("twins", TWINS), ("loop", LOOP)) for r in report(db, q)]
    return spark.createDataFrame(rows, "query string, what string, atom string, other string, kind string")


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, len(x["columns"]), len(x["data"]), x["row_count"]) for name, x in previews(tables(spark, sf_dir), 5).items()]
    return spark.createDataFrame(rows, "table_name string, n_columns int, n_shown int, n_rows long")


def catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key columns that a constraint catalogue declares."""
    rows = [("Primary Key", "LINEITEM(L_ORDERKEY,L_LINENUMBER)"), ("Primary Key", "PART(P_PARTKEY)"), ("Denial Constraint", "t(PART);t.P_SIZE < 0")]
    keys = declared_keys(spark.createDataFrame(rows, "constraint_type string, constraint_definition string"))
    return spark.createDataFrame([(t, c, i) for t, own in keys.items() for i, c in enumerate(own)], "table_name string, column_name string, position int")


def reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, written as delimited rows and loaded again."""
    path, rows = f"{shared_dir(spark).rstrip('/')}/customer-{uuid.uuid4().hex}", parquet(spark, sf_dir, "customer")
    rows.write.csv(path, sep="|", header=True)
    return delimited(spark, path, rows.schema, header=True)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a sample of customers in the order of a hash."""
    return ranked(parquet(spark, sf_dir, "customer"), ["c_custkey"]).where("rank < 100").select("c_custkey", F.col("rank").cast("long").alias("rank"))


def engine(f: Callable[[Engine], DataFrame]) -> Run:
    return lambda spark, sf_dir: f(Engine(tables(spark, sf_dir)))


def queries() -> dict[str, Run]:
    return {
        "row_counts": row_counts,
        "violating_keys": lambda s, d: blocks.violating_keys(lineitem(s, d)),
        "clean_part": lambda s, d: blocks.clean_part(lineitem(s, d)).select(*LINE_KEY, "l_partkey", "l_quantity"),
        "dirty_part": lambda s, d: blocks.dirty_part(lineitem(s, d)).select(*LINE_KEY, "l_partkey", "l_quantity"),
        "block_histogram": lambda s, d: blocks.histogram(lineitem(s, d)),
        "possible_lines": engine(lambda e: e.possible(LINES)),
        "clean_answers": engine(lambda e: e.certain(LINES, strategy="clean")),
        "certain_lines": engine(lambda e: e.certain(LINES)),
        "certain_lines_blocks": engine(lambda e: e.certain(LINES, strategy="blocks")),
        "certain_lines_search": engine(lambda e: e.certain(LINES, strategy="search")),
        "suspect_lines": engine(lambda e: e.suspect(LINES)),
        "certain_suppliers": engine(lambda e: e.certain(SUPPLIERS)),
        "certain_boolean": engine(lambda e: e.certain(ANY)),
        "certain_boolean_join": engine(lambda e: e.certain(ANY_BRAND)),
        "possible_brands": engine(lambda e: e.possible(BRANDS)),
        "certain_brands": engine(lambda e: e.certain(BRANDS)),
        "certain_brands_blocks": engine(lambda e: e.certain(BRANDS, strategy="blocks")),
        "certain_brands_search": engine(lambda e: e.certain(BRANDS, strategy="search")),
        "certain_segments": engine(lambda e: e.certain(SEGMENTS)),
        "certain_nations": engine(lambda e: e.certain(NATIONS)),
        "certain_union": engine(lambda e: e.certain(FLAGGED, OPEN)),
        "certain_twins": engine(lambda e: e.certain(TWINS)),
        "witness_counts": lambda s, d: certain.witnesses(tables(s, d), BRANDS).groupBy("p_brand").agg(F.count("*").alias("n_witnesses"), F.sum((F.size(certain.DIRTY) == 0).cast("long")).alias("n_clean")),
        "relevant_facts": lambda s, d: certain.relevant_facts(tables(s, d), BRANDS, 0),
        "range_scalar": engine(lambda e: cents(e.ranges(QUANTITIES, "v"))),
        "range_by_flag": engine(lambda e: cents(e.ranges(BY_FLAG, "v"))),
        "range_by_brand": engine(lambda e: cents(e.ranges(BY_BRAND, "v"))),
        "range_by_brand_search": lambda s, d: cents(search.all_ranges(tables(s, d), BY_BRAND, "v")),
        "range_negative_join": lambda s, d: cents(Engine(shifted(s, d)).ranges(BY_KEPT, "v", "sum")),
        "range_chain_search": lambda s, d: search.ranges_by_search(generated_chain(s, d), REACHED),
        "certain_brands_division": engine(lambda e: e.certain(BRANDS, strategy="division")),
        "certain_forest": engine(lambda e: e.certain(FOREST).groupBy("n_name", "p_brand").agg(F.count("*").alias("n_lines"))),
        "certain_within": engine(lambda e: e.within(e.certain(SUPPLIERS), 600)),
        "range_by_flag_search": lambda s, d: cents(search.ranges_by_search(tables(s, d), BY_FLAG, "v")),
        "extremes_by_flag_search": lambda s, d: search.extremes_by_search(tables(s, d), BY_FLAG, "v"),
        "denial_violations": lambda s, d: denial.conflict_counts(order_denials(s, d), status_denial()),
        "denial_minimal": smallest_violations,
        "denial_join_values": priorities,
        "analysis_report": reported,
        "table_previews": previewed,
        "catalogue_keys": catalogued,
        "delimited_customers": reread,
        "generated_for_query": lambda s, d: generated_brands(s, d).tables["lineitem"].frame,
        "denial_safe_orders": lambda s, d: denial.in_every_repair(order_denials(s, d), "orders").select("o_orderkey", "o_custkey"),
        "denial_certain_values": lambda s, d: denial.certain_values(order_denials(s, d), "orders", ["o_custkey", "o_orderpriority"]),
        "hash_sample": marked,
        "generated_rows": lambda s, d: generated_chain(s, d).tables["r1"].frame,
        "certain_chain": lambda s, d: Engine(generated_chain(s, d)).certain(PATH),
        "injected_customers": lambda s, d: injected(parquet(s, d, "customer"), ["c_custkey"]).select("c_custkey", "c_name", "c_mktsegment"),
    }


PART = f"(SELECT {PART_KEY} AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part)"
ORDERS = f"(SELECT {ORDER_KEY} AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)"
SIZED = "(SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM (SELECT DISTINCT * FROM lineitem))"
CERTAIN_LINES = """SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING bool_and(l_quantity > 10) AND count(DISTINCT l_returnflag) = 1"""
POSSIBLE_LINES = "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity > 10"
CHILD = f"""p AS (SELECT DISTINCT p_partkey, p_brand, p_size FROM {PART}),
pn AS (SELECT p_partkey, count(*) AS n FROM p GROUP BY p_partkey),
b AS (SELECT p.p_partkey, p_brand, count(*) = any_value(pn.n) AS sure FROM p JOIN pn ON p.p_partkey = pn.p_partkey
      WHERE p_size > 5 GROUP BY p.p_partkey, p_brand)"""
SURE_BRANDS = f"""WITH {CHILD}
SELECT l.l_orderkey, l.l_linenumber, b.p_brand FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l
JOIN (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) ln USING (l_orderkey, l_linenumber)
JOIN b ON b.p_partkey = l.l_partkey AND b.sure
GROUP BY l.l_orderkey, l.l_linenumber, b.p_brand HAVING count(*) = any_value(ln.n)"""
NESTED_BRANDS = f"""WITH p AS {PART}
SELECT DISTINCT a.l_orderkey, a.l_linenumber, ap.p_brand FROM lineitem a JOIN p ap ON ap.p_partkey = a.l_partkey
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = a.l_orderkey AND l.l_linenumber = a.l_linenumber AND NOT (
  EXISTS (SELECT 1 FROM p WHERE p.p_partkey = l.l_partkey)
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.p_partkey = l.l_partkey AND NOT (p.p_brand = ap.p_brand AND p.p_size > 5))))"""
RANGE = """count(*) FILTER (WHERE whole) AS count_glb, count(*) AS count_lub,
  round(sum(CASE WHEN whole THEN low ELSE least(low, 0) END), 2) AS sum_glb,
  round(sum(CASE WHEN "full" THEN high ELSE greatest(high, 0) END), 2) AS sum_lub,
  min(low) AS min_glb, min(high) FILTER (WHERE whole) AS min_lub, max(low) FILTER (WHERE whole) AS max_glb, max(high) AS max_lub"""


def generated_sql(seed: int) -> str:
    return f"""(SELECT CAST(CASE WHEN i < n - d THEN i ELSE n - d + (i - n + d) // 2 END AS BIGINT) AS key,
CAST(CASE WHEN (i + {seed}) * 7919 % 100 < 60 THEN (i + {seed}) * 104729 % (n - d // 2) ELSE i + n - d // 2 END AS BIGINT) AS ref, substr(md5('{seed}-' || i), 1, 16) AS value
FROM (SELECT n, n * 10 // 100 // 2 * 2 AS d, unnest(range(n)) AS i FROM (SELECT count(*) AS n FROM orders)))"""


def oracle_sql() -> dict[str, str]:
    counts = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
    flags = f"""b AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) = any_value(n) AS whole, count(*) = any_value(n) AS "full", min(l_quantity) AS low, max(l_quantity) AS high
FROM {SIZED} WHERE l_quantity > 10 GROUP BY ALL)"""
    by_brand = f"""WITH {CHILD}, l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)),
r AS (SELECT l_orderkey, l_linenumber, p_brand, count(*) FILTER (WHERE sure) = any_value(l.n) AS whole, count(*) = any_value(l.n) AS "full", min(l_quantity) AS low, max(l_quantity) AS high
FROM l JOIN b ON b.p_partkey = l.l_partkey WHERE l_quantity > 10 GROUP BY l_orderkey, l_linenumber, p_brand)
SELECT p_brand, {RANGE} FROM r GROUP BY p_brand HAVING count(*) FILTER (WHERE whole) > 0"""
    return {
        "row_counts": counts,
        "violating_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM (SELECT DISTINCT * FROM lineitem) GROUP BY ALL HAVING count(*) > 1",
        "clean_part": f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM {SIZED} WHERE n = 1",
        "dirty_part": f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM {SIZED} WHERE n > 1",
        "block_histogram": "SELECT n AS block_size, count(*) AS n_blocks FROM (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM lineitem) GROUP BY l_orderkey, l_linenumber) GROUP BY n",
        "possible_lines": POSSIBLE_LINES,
        "clean_answers": "SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem) GROUP BY ALL HAVING count(*) = 1 AND bool_and(l_quantity > 10)".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber"),
        "certain_lines": CERTAIN_LINES,
        "certain_lines_blocks": CERTAIN_LINES,
        "certain_lines_search": CERTAIN_LINES,
        "suspect_lines": f"{POSSIBLE_LINES} EXCEPT ({CERTAIN_LINES})",
        "certain_suppliers": "SELECT DISTINCT s AS l_suppkey FROM (SELECT min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING bool_and(l_quantity > 45) AND count(DISTINCT l_suppkey) = 1)",
        "certain_boolean": "SELECT count(*) > 0 AS cons_answer FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING bool_and(l_quantity > 49 AND l_returnflag = 'R'))",
        "certain_boolean_join": f"""WITH p AS {PART}, b AS (SELECT p_partkey FROM p GROUP BY p_partkey HAVING bool_and(p_brand = 'Brand#11'))
SELECT count(*) > 0 AS cons_answer FROM (SELECT 1 FROM lineitem LEFT JOIN b ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber HAVING bool_and(l_quantity > 49 AND p_partkey IS NOT NULL))""",
        "possible_brands": f"SELECT DISTINCT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN {PART} ON p_partkey = l_partkey WHERE p_size > 5",
        "certain_brands": NESTED_BRANDS,
        "certain_brands_blocks": SURE_BRANDS,
        "certain_brands_search": SURE_BRANDS,
        "certain_segments": f"""WITH o AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM {ORDERS}),
os AS (SELECT o.o_orderkey, c_mktsegment FROM o JOIN (SELECT o_orderkey, count(*) AS n FROM o GROUP BY ALL) s USING (o_orderkey) JOIN customer ON c_custkey = o_custkey
       WHERE o_orderstatus <> 'P' GROUP BY o.o_orderkey, c_mktsegment HAVING count(*) = any_value(s.n)),
l AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING bool_and(l_quantity > 5))
SELECT l_orderkey, l_linenumber, c_mktsegment FROM l JOIN os ON o_orderkey = l_orderkey""",
        "certain_nations": "SELECT n_name FROM nation JOIN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING bool_and(s_acctbal > 0)) ON s_nationkey = n_nationkey",
        "certain_union": "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING bool_and(l_returnflag = 'A' OR l_linestatus = 'O')",
        "certain_twins": """WITH x AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_suppkey) AS s, count(DISTINCT l_suppkey) AS k FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
SELECT a.o FROM x a JOIN x b ON a.o = b.o AND a.n = 1 AND b.n = 2 WHERE a.k = 1 AND b.k = 1 AND a.s = b.s""",
        "witness_counts": f"""WITH p AS (SELECT DISTINCT p_partkey, p_brand, p_size FROM {PART}), ps AS (SELECT *, count(*) OVER (PARTITION BY p_partkey) AS pn FROM p),
l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS ln FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))
SELECT p_brand, count(*) AS n_witnesses, count(*) FILTER (WHERE pn = 1 AND ln = 1) AS n_clean FROM l JOIN ps ON p_partkey = l_partkey WHERE p_size > 5 GROUP BY p_brand""",
        "relevant_facts": f"""WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS ln FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)),
t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM l JOIN {PART} ON p_partkey = l_partkey WHERE p_size > 5 AND ln > 1)
SELECT l_orderkey, l_linenumber, l_partkey FROM l SEMI JOIN t USING (l_orderkey, l_linenumber)""",
        "range_scalar": f"""WITH b AS (SELECT l_orderkey, l_linenumber, count(*) = any_value(n) AS whole, count(*) = any_value(n) AS "full", min(l_quantity) AS low, max(l_quantity) AS high
FROM {SIZED} WHERE l_returnflag = 'R' GROUP BY ALL) SELECT count(*) FILTER (WHERE whole) > 0 AS cons_answer, {RANGE} FROM b""",
        "range_by_flag": f"WITH {flags} SELECT l_returnflag, {RANGE} FROM b GROUP BY l_returnflag HAVING count(*) FILTER (WHERE whole) > 0",
        "range_by_brand": by_brand,
        "range_by_brand_search": by_brand,
        "range_negative_join": f"""WITH o AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM {ORDERS}), os AS (SELECT o_orderkey, bool_and(o_orderstatus <> 'P') AS sure, bool_or(o_orderstatus <> 'P') AS may FROM o GROUP BY o_orderkey),
l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_quantity - 25 AS v FROM lineitem)),
b AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) = any_value(n) AS whole, min(v) AS low, max(v) AS high FROM l GROUP BY ALL),
s AS (SELECT l_orderkey, l_returnflag, sum(CASE WHEN whole THEN low ELSE least(low, 0) END) AS low, sum(CASE WHEN whole THEN high ELSE greatest(high, 0) END) AS high FROM b GROUP BY ALL)
SELECT l_returnflag, round(sum(CASE WHEN sure THEN low ELSE least(low, 0) END), 2) AS sum_glb, round(sum(CASE WHEN sure THEN high ELSE greatest(high, 0) END), 2) AS sum_lub
FROM s JOIN os ON o_orderkey = l_orderkey WHERE may GROUP BY l_returnflag""",
        "range_chain_search": f"""WITH a AS (SELECT DISTINCT key, ref FROM {generated_sql(1)}), b AS (SELECT DISTINCT key, ref FROM {generated_sql(2)}), c AS (SELECT DISTINCT key FROM {generated_sql(3)}),
s AS (SELECT key, bool_and(ref IN (SELECT key FROM c)) AS sure, bool_or(ref IN (SELECT key FROM c)) AS may FROM b GROUP BY key),
r AS (SELECT a.key, bool_and(coalesce(sure, false)) AS sure, bool_or(coalesce(may, false)) AS may FROM a LEFT JOIN s ON s.key = a.ref GROUP BY a.key)
SELECT CAST(count(*) FILTER (WHERE sure) AS DOUBLE) AS glb, CAST(count(*) FILTER (WHERE may) AS DOUBLE) AS lub FROM r""",
        "certain_brands_division": SURE_BRANDS,
        "certain_forest": f"""SELECT n_name, p_brand, count(*) AS n_lines FROM ({SURE_BRANDS}),
(SELECT n_name FROM nation JOIN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING bool_and(s_acctbal > 0)) ON s_nationkey = n_nationkey) GROUP BY ALL""",
        "certain_within": "SELECT DISTINCT s AS l_suppkey FROM (SELECT min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING bool_and(l_quantity > 45) AND count(DISTINCT l_suppkey) = 1)",
        "range_by_flag_search": f"WITH {flags} SELECT l_returnflag, round(sum(CASE WHEN whole THEN low ELSE 0 END), 2) AS glb, round(sum(high), 2) AS lub FROM b GROUP BY l_returnflag HAVING count(*) FILTER (WHERE whole) > 0",
        "extremes_by_flag_search": f"WITH {flags} SELECT l_returnflag, min_glb, min_lub, max_glb, max_lub FROM (SELECT l_returnflag, {RANGE} FROM b GROUP BY l_returnflag HAVING count(*) FILTER (WHERE whole) > 0)",
        "denial_violations": "SELECT a.o_custkey, count(*) AS n_violations FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus <> b.o_orderstatus GROUP BY a.o_custkey",
        "denial_minimal": """WITH s AS (SELECT DISTINCT * FROM supplier), one AS (SELECT s_suppkey FROM s WHERE s_acctbal < -800), k AS (SELECT * FROM s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM one))
SELECT 1 AS n_rows, count(*) AS n_violations FROM one HAVING count(*) > 0
UNION ALL SELECT 2, count(*) FROM k a JOIN k b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_acctbal > 8000 AND b.s_acctbal > 8000 HAVING count(*) > 0
UNION ALL SELECT 3, count(*) FROM k a JOIN k b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal JOIN k c ON b.s_nationkey = c.s_nationkey AND b.s_acctbal < c.s_acctbal
WHERE a.s_acctbal > 5000 AND b.s_acctbal <= 8000 HAVING count(*) > 0""",
        "denial_join_values": """WITH o AS (SELECT o_custkey AS c, o_orderpriority AS p, o_totalprice > 200000 AS big FROM orders), x AS (SELECT c_custkey AS c, c_acctbal < 0 AND c_custkey IN (SELECT c FROM o WHERE big) AS torn FROM customer)
SELECT c, p FROM o JOIN x USING (c) WHERE NOT torn UNION SELECT c, p FROM o WHERE big AND c NOT IN (SELECT c FROM x WHERE torn)
UNION (SELECT c, p FROM o JOIN x USING (c) WHERE torn AND big INTERSECT SELECT c, p FROM o JOIN x USING (c) WHERE torn AND NOT big)""",
        "analysis_report": """SELECT * FROM (VALUES
('segments', 'order', '0:lineitem', '', '0'), ('segments', 'order', '1:orders', '', '1'), ('segments', 'order', '2:customer', '', '2'), ('segments', 'join', '1:orders', '2:customer', 'nonkey'),
('segments', 'attack', '1:orders', '2:customer', 'weak'), ('segments', 'parent', '0:lineitem', '', 'root'), ('segments', 'parent', '1:orders', '', 'root'), ('segments', 'parent', '2:customer', '1:orders', 'child'),
('segments', 'query', '', '', 'first-order'), ('segments', 'query', '', '', 'forest'), ('segments', 'query', '', '', 'self-join-free'), ('segments', 'query', '', '', 'blocks'),
('path', 'attack', '0:r1', '1:r2', 'weak'), ('path', 'attack', '1:r2', '2:r3', 'weak'), ('path', 'attack', '0:r1', '2:r3', 'weak'), ('path', 'join', '0:r1', '1:r2', 'nonkey'), ('path', 'join', '1:r2', '2:r3', 'nonkey'),
('path', 'order', '0:r1', '', '0'), ('path', 'order', '1:r2', '', '1'), ('path', 'order', '2:r3', '', '2'), ('path', 'parent', '0:r1', '', 'root'), ('path', 'parent', '1:r2', '0:r1', 'child'), ('path', 'parent', '2:r3', '1:r2', 'child'),
('path', 'query', '', '', 'first-order'), ('path', 'query', '', '', 'forest'), ('path', 'query', '', '', 'self-join-free'), ('path', 'query', '', '', 'blocks'),
('twins', 'join', '0:lineitem', '1:lineitem', 'nonkey'), ('twins', 'join', '1:lineitem', '0:lineitem', 'nonkey'), ('twins', 'attack', '0:lineitem', '1:lineitem', 'strong'), ('twins', 'attack', '1:lineitem', '0:lineitem', 'strong'),
('twins', 'query', '', '', 'unknown'), ('twins', 'query', '', '', 'no forest'), ('twins', 'query', '', '', 'self-join'), ('twins', 'query', '', '', 'search'),
('loop', 'join', '0:r1', '1:r2', 'nonkey'), ('loop', 'join', '1:r2', '0:r1', 'nonkey'), ('loop', 'attack', '0:r1', '1:r2', 'weak'), ('loop', 'attack', '1:r2', '0:r1', 'weak'),
('loop', 'query', '', '', 'polynomial'), ('loop', 'query', '', '', 'no forest'), ('loop', 'query', '', '', 'self-join-free'), ('loop', 'query', '', '', 'search')) t(query, what, atom, other, kind)""",
        "table_previews": " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({n} AS INTEGER) AS n_columns, CAST(least(count(*), 5) AS INTEGER) AS n_shown, count(*) AS n_rows FROM {t}" for t, n in (("lineitem", 11), ("part", 6), ("orders", 6), ("customer", 5), ("supplier", 4), ("nation", 3))),
        "catalogue_keys": "SELECT * FROM (VALUES ('LINEITEM', 'L_ORDERKEY', 0), ('LINEITEM', 'L_LINENUMBER', 1), ('PART', 'P_PARTKEY', 0)) t(table_name, column_name, position)",
        "delimited_customers": "SELECT * FROM customer",
        "generated_for_query": """WITH r AS (SELECT unnest(range(count(*))) AS i FROM orders), x AS (SELECT i, i * 7919 % 100 < 50 AS hit, CASE WHEN i // 3 % 100 < 10 THEN i % 3 + 1 ELSE 0 END AS more FROM r),
c AS (SELECT i, hit, unnest(range(0, more + 1)) AS k FROM x), n AS (SELECT i, k, CASE WHEN hit THEN '-' ELSE '-lineitem-' END || i AS own FROM c)
SELECT substr(md5('0-l_orderkey' || own), 1, 16) AS l_orderkey, substr(md5('0-l_linenumber' || own), 1, 16) AS l_linenumber,
substr(md5(CASE WHEN k = 0 THEN '0-p' || own ELSE '0-p-lineitem-' || i || '-' || k END), 1, 16) AS l_partkey FROM n""",
        "denial_safe_orders": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice >= 1500 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = o.o_custkey AND b.o_orderstatus <> o.o_orderstatus AND b.o_totalprice >= 1500)",
        "denial_certain_values": """WITH o AS (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice >= 1500), s AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM o GROUP BY ALL)
SELECT o.o_custkey, o.o_orderpriority FROM o JOIN s USING (o_custkey) GROUP BY o.o_custkey, o.o_orderpriority HAVING count(DISTINCT o_orderstatus) = any_value(s.n)""",
        "hash_sample": "SELECT c_custkey, rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) - 1 AS rank FROM customer) WHERE rank < 100",
        "generated_rows": f"SELECT * FROM {generated_sql(1)}",
        "certain_chain": f"""WITH s AS (SELECT key FROM {generated_sql(2)} GROUP BY key HAVING bool_and(ref IN (SELECT key FROM {generated_sql(3)})))
SELECT key AS x FROM {generated_sql(1)} GROUP BY key HAVING bool_and(ref IN (SELECT key FROM s))""",
        "injected_customers": """WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) - 1 AS rank FROM customer),
x AS (SELECT 10 * count(*) // (2700 - 210) AS x FROM customer),
t AS (SELECT c_custkey, rank, rank // x AS s, x FROM r, x WHERE rank < 6 * x),
d AS (SELECT c_custkey, unnest(range(0, s + 1)) AS k, s, rank, x FROM t)
SELECT c_custkey, c_name, c_mktsegment FROM customer
UNION ALL SELECT d.c_custkey, r.c_name, r.c_mktsegment FROM d JOIN r ON r.rank = 6 * x + (s * (s + 1) // 2) * x + (d.rank - s * x) * (s + 1) + k""",
    }

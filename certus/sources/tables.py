"""Reading tables, and looking at them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from certus.functions.storage import saved
from certus.plans.query import Database


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: StructType | str, separator: str = "|", header: bool = False) -> DataFrame:
    """A file of delimited rows with a known schema."""
    return spark.read.csv(path, schema=schema, sep=separator, header=header)


def database(spark: SparkSession, sf_dir: str, keys: dict[str, list[str]]) -> Database:
    """The named Parquet tables of a folder, with their declared keys."""
    db = Database()
    for name, key in keys.items():
        db.register(name, parquet(spark, sf_dir, name), key)
    return db


def declared_keys(constraints: DataFrame) -> dict[str, list[str]]:
    """Keys of a constraint catalogue: rows with type "Primary Key" and a definition like PARTSUPP(PS_PARTKEY,PS_SUPPKEY).

    The catalogue is as small as the schema, and so it is collected.
    """
    out = {}
    for r in constraints.where("lower(constraint_type) = 'primary key'").select("constraint_definition").collect():
        name, _, columns = r.constraint_definition.partition("(")
        out[name.strip()] = [c.strip() for c in columns.rstrip(") ").split(",")]
    return out


def preview(df: DataFrame, n: int = 10, once: bool = False) -> dict:
    """Column names, the first n rows and the number of all rows; once: a result is kept first, so that its plan runs a single time."""
    df = saved(df) if once else df
    return {"columns": df.columns, "data": [json.loads(x) for x in df.limit(n).toJSON().collect()], "row_count": df.count()}


def previews(db: Database, n: int = 10) -> dict[str, dict]:
    """A preview of every table."""
    return {name: preview(t.frame, n) for name, t in db.tables.items()}

"""Queries as data: atoms that bind columns to variables, conjunctive queries, unions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

#: What the names of all internal columns begin with; no variable or column of a table may.
OWN = "__certus_"


def free_names(names: set[str] | list[str], what: str) -> None:
    """Raises ValueError for names that differ by case only or begin like internal ones."""
    if taken := sorted(n for n in names if n.lower().startswith(OWN)):
        raise ValueError(f"{what} with reserved names: {taken}")
    by: dict[str, set[str]] = {}
    for n in names:
        by.setdefault(n.lower(), set()).add(n)
    if alike := sorted(sorted(x) for x in by.values() if len(x) > 1):
        raise ValueError(f"{what} that differ by case only: {alike}")


@dataclass(frozen=True)
class Table:
    """A table with a declared key, which its rows may violate."""

    frame: DataFrame
    key: tuple[str, ...]

    @cached_property
    def rows(self) -> int:
        """Number of rows, counted once; of Parquet files the footers tell."""
        return self.frame.count()


@dataclass(frozen=True)
class Atom:
    """A table whose columns are bound to variables, and a condition on its rows.

    A column bound to the same variable as another one, here or in another
    atom, must be equal to it. Constants are part of the condition. A row for
    which the condition is unknown doesn't meet it.
    """

    table: str
    binds: tuple[tuple[str, str], ...]
    where: str = "true"

    @property
    def variables(self) -> set[str]:
        return {v for _, v in self.binds}


def atom(name: str, condition: str = "true", /, **binds: str) -> Atom:
    """atom("part", "p_size > 5", p_partkey="p", p_brand="brand")"""
    return Atom(name, tuple(binds.items()), condition)


@dataclass(frozen=True)
class Query:
    """A conjunctive query: the free variables are its answers; none: a Boolean query.

    Variables may have any names but those that begin like internal columns
    (``OWN``) and those that differ from another by case only: ValueError.
    """

    free: tuple[str, ...]
    atoms: tuple[Atom, ...]

    def __post_init__(self) -> None:
        missing = set(self.free) - {v for a in self.atoms for v in a.variables}
        if missing:
            raise ValueError(f"free variables that no atom binds: {sorted(missing)}")
        free_names({v for a in self.atoms for v in a.variables}, "variables")


@dataclass(frozen=True)
class Chain:
    """Rows that agree on some columns, each with a condition of its own, in which a column rises if one is named."""

    same: tuple[str, ...]
    rows: tuple[str, ...]
    by: str | None


@dataclass(frozen=True)
class Denial:
    """No rows of the tables may together meet the condition.

    ``aliases`` are pairs of alias and table; the condition names columns as
    alias.column. With ``symmetric`` every pair of rows is looked at once.
    ``same`` and ``differs`` are set by agreeing(), ``chain`` by chained().
    """

    aliases: tuple[tuple[str, str], ...]
    condition: str
    symmetric: bool = False
    same: tuple[str, ...] = ()
    differs: tuple[str, ...] = ()
    chain: Chain | None = None


def agreeing(table: str, same: list[str] | tuple[str, ...], differs: str) -> Denial:
    """Rows of a table that agree on some columns must agree on another one; null agrees with and differs from nothing.

    Such a constraint is looked at by classes of rows and not by pairs.
    """
    condition = " AND ".join([*(f"a.`{c}` = b.`{c}`" for c in same), f"a.`{differs}` <> b.`{differs}`"])
    return Denial((("a", table), ("b", table)), condition, True, tuple(same), (differs,))


def chained(table: str, same: list[str] | tuple[str, ...], rows: list[str] | tuple[str, ...], by: str | None = None) -> Denial:
    """No rows of a table that agree on some columns may meet a condition each, one after another as ``by`` rises.

    In the conditions {r} stands for the row, as in "{r}.s_acctbal > 8000".
    Without ``by`` they are all the same and any rows count. Violations of
    such constraints can be counted without being written out.
    """
    if not rows or (by is None and len(set(rows)) > 1):
        raise ValueError("conditions of rows without an order are all the same")
    names = [f"r{i}" for i in range(len(rows))]
    parts = [f"({c.format(r=n)})" for c, n in zip(rows, names, strict=True)]
    for a, b in zip(names, names[1:], strict=False):
        parts += [f"{a}.`{c}` = {b}.`{c}`" for c in same] + ([f"{a}.`{by}` < {b}.`{by}`"] if by else [])
    return Denial(tuple((n, table) for n in names), " AND ".join(parts), by is None, chain=Chain(tuple(same), tuple(rows), by))


@dataclass
class Database:
    """Tables by name, with keys and denial constraints."""

    tables: dict[str, Table] = field(default_factory=dict)
    denials: list[Denial] = field(default_factory=list)

    def register(self, name: str, frame: DataFrame, key: list[str] | tuple[str, ...]) -> "Database":
        missing = set(key) - set(frame.columns)
        if missing or not key:
            raise ValueError(f"{name} has no key columns {sorted(missing)}")
        free_names(list(frame.columns), f"columns of {name}")
        self.tables[name] = Table(frame, tuple(key))
        return self

    def key_variables(self, a: Atom) -> set[str]:
        """Variables in the key; a key column that isn't bound has a variable of its own."""
        bound = {c.lower(): v for c, v in a.binds}
        return {bound.get(c.lower(), f"{a.table}.{c}") for c in self.tables[a.table].key}

    def rows(self, *queries: Query) -> int:
        """Number of rows of the largest table that some queries use."""
        return max(self.tables[t].rows for t in {a.table for q in queries for a in q.atoms})

    def keyed(self, q: Query) -> bool:
        """Whether the answers hold the key of the largest table, so that few rows share one."""
        largest = max(q.atoms, key=lambda a: self.tables[a.table].rows)
        return self.key_variables(largest) <= set(q.free)

"""The best sum, or the least maximum, over all ways to pick one row of each block.

A witness is a set of blocks with a row for each, and a value that counts if
all of them are picked. Blocks are eliminated one at a time, the cheapest
first: the tables that name a block are combined, and the best of its rows
stays for each combination of rows of its neighbours. Rows that a table does
not name are one entry of it, so paths, trees and stars of any size take time
in proportion. Where even the cheapest table would pass ``CELLS``, the busiest
block's rows are tried one after another, which bounds the memory and not what
can be solved. Nothing recurses on the Python stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from math import inf

import numpy as np

CELLS = 1 << 20
#: Witnesses for which tables aren't worth building.
HANDFUL = 4
#: A row for each of several blocks, and a value.
Witness = tuple[dict, float]


@dataclass(frozen=True)
class Measure:
    """How values combine, what no value is, and the least that there can be."""

    combine: Callable
    nothing: float
    least: float


SUM, TOP = Measure(np.add, 0.0, -inf), Measure(np.maximum, -inf, -inf)


@dataclass
class Values:
    """A value for the rows of some blocks; entry 0 of each axis is for rows that aren't named."""

    rows: dict
    table: np.ndarray


def _table(w: dict, value: float, m: Measure) -> Values:
    table = np.full((2,) * len(w), m.nothing)
    table[(1,) * len(w)] = value
    return Values({b: {w[b]: 1} for b in sorted(w)}, table)


def _merged(tables: Iterable[Values]) -> dict:
    rows: dict = {}
    for t in tables:
        for b, named in t.rows.items():
            own = rows.setdefault(b, {})
            for f in named:
                own.setdefault(f, len(own) + 1)
    return {b: rows[b] for b in sorted(rows)}


def _cells(tables: Iterable[Values]) -> float:
    out = 1.0
    for named in _merged(tables).values():
        out *= len(named) + 1
    return out


def _without(block, tables: list[Values], size: int, m: Measure) -> Values:
    """The tables combined, and the best row of a block taken."""
    rows = _merged(tables)
    total = np.full([len(named) + 1 for named in rows.values()], m.nothing)
    for t in tables:
        at, shape = [], []
        for b, named in rows.items():
            if b in t.rows:
                index = np.zeros(len(named) + 1, np.int64)
                for f, k in t.rows[b].items():
                    index[named[f]] = k
                at.append(index)
                shape.append(len(named) + 1)
            else:
                shape.append(1)
        total = m.combine(total, t.table[np.ix_(*at)].reshape(shape))
    axis = list(rows).index(block)
    if len(rows[block]) == size:  # every row is named
        total = np.delete(total, 0, axis)
    return Values({b: named for b, named in rows.items() if b != block}, total.min(axis))


def _picked(block, row, t: Values) -> Values:
    if block not in t.rows:
        return t
    at = t.rows[block].get(row, 0)
    return Values({b: named for b, named in t.rows.items() if b != block}, t.table.take(at, list(t.rows).index(block)))


def _apart(tables: list[Values]) -> list[list[Values]]:
    """Tables that share no block, directly or through others, apart."""
    up = list(range(len(tables)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    owner: dict = {}
    for k, t in enumerate(tables):
        for b in t.rows:
            up[top(k)] = top(owner.setdefault(b, k))
    parts: dict[int, list[Values]] = {}
    for k, t in enumerate(tables):
        parts.setdefault(top(k), []).append(t)
    return list(parts.values())


def _eliminated(tables: list[Values], sizes: dict, m: Measure) -> tuple[float, list[Values]]:
    """A constant, and the tables that are left where no block is cheap."""
    total, of = m.nothing, {}  # of: by block, the tables that name it by their ids
    for t in tables:
        if not t.rows:
            total = float(m.combine(total, t.table))
        for b in t.rows:
            of.setdefault(b, {})[id(t)] = t
    heap = [(_cells(own.values()), b) for b, own in of.items()]
    heapify(heap)
    fresh = True
    while heap:
        _, b = heappop(heap)
        cost = _cells(of[b].values())
        if heap and cost > heap[0][0]:
            heappush(heap, (cost, b))
            continue
        if cost > CELLS:
            heap = [(_cells(of[x].values()), x) for x in of]
            heapify(heap)
            if fresh and heap[0][0] > CELLS:
                break
            fresh = True
            continue
        fresh = False
        own = of.pop(b)
        made = _without(b, list(own.values()), sizes[b], m)
        for k, t in own.items():
            for x in t.rows:
                if x != b:
                    del of[x][k]
        for x in made.rows:
            of[x][id(made)] = made
        if not made.rows:
            total = float(m.combine(total, made.table))
    return total, list({k: t for own in of.values() for k, t in own.items()}.values())


def _solve(tables: list[Values], sizes: dict, m: Measure) -> Iterator:
    """Yields the problems that it needs solved, and returns the answer."""
    total, left = _eliminated(tables, sizes, m)
    for part in _apart(left):
        uses: dict = {}
        for t in part:
            for b in t.rows:
                uses[b] = uses.get(b, 0) + 1
        block = max(uses, key=lambda b: (uses[b], b))
        rows = sorted(_merged([t for t in part if block in t.rows])[block])
        best = inf
        for row in [*([None] if len(rows) < sizes[block] else []), *rows]:
            best = min(best, (yield [_picked(block, row, t) for t in part]))
            if best == m.least:
                break
        total = float(m.combine(total, best))
    return total


def least(ws: list[Witness], sizes: dict, m: Measure) -> float:
    """The least that the values of the witnesses that a pick keeps combine to."""
    waiting = [_solve([_table(w, v, m) for w, v in ws], sizes, m)]
    answer = None
    while True:
        try:
            problem = waiting[-1].send(answer)
        except StopIteration as done:
            waiting.pop()
            answer = done.value
            if not waiting:
                return answer
        else:
            waiting.append(_solve(problem, sizes, m))
            answer = None


def minimal(ws: list[dict]) -> list[dict]:
    """The witnesses that hold no other one."""
    by_row: dict = {}
    out = []
    for w in sorted(ws, key=len):
        items = set(w.items())
        if not w or any(o <= items for x in items for o in by_row.get(x, [])) or () in by_row:
            if w or out:
                continue
        out.append(w)
        if items:
            by_row.setdefault(min(items), []).append(items)
        else:
            by_row[()] = []
    return out


def _broken(ws: list[dict], sizes: dict) -> bool:
    """breakable() for a handful of witnesses: tries the rows of the first one's blocks."""
    if not ws:
        return True
    for block in ws[0]:
        rows = {w[block] for w in ws if block in w}
        for row in rows - {ws[0][block]} if len(rows) == sizes[block] else [None]:
            left = [{b: f for b, f in w.items() if b != block} for w in ws if w.get(block, row) == row]
            if all(left) and _broken(left, sizes):
                return True
    return False


def breakable(ws: list[dict], sizes: dict) -> bool:
    """Whether some pick breaks every witness."""
    if not all(ws):
        return False
    if len(ws) <= HANDFUL:
        return _broken(ws, sizes)
    return least([(w, 1.0) for w in minimal(ws)], sizes, TOP) == -inf

"""Nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts
with few crossing edges. A small classifier learns which parts hold a vector's
neighbours. It deals every row of the table to its most probable part, and
sends each query to its several most probable parts, where all candidates are
ranked by exact inner product. How many parts that is, an audit decides: a
bounded number of queries is compared with all rows, and the fewest parts with
which their recall reaches the target are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certus.llm.vectors import matrix, usable

#: Bounds of the fitted sample: rows at least, and rows for each part; neighbours in its graph; units of the classifier.
SAMPLE, SAMPLE_OF_PART, GRAPH_NEIGHBOURS, HIDDEN = 4096, 16, 12, 128
#: Rows that a part should have, and bounds of the number of parts, which follows the number of rows.
PART_ROWS, FEWEST, MOST = 2048, 16, 1024
#: Queries that are audited against all rows, and the recall that they must reach.
AUDITED, RECALL = 128, 0.95
#: Rows and queries that one task compares.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k rows with the largest inner product, for each row."""
    k, out = min(k, len(x) - 1), []
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), np.int64))
    return np.concatenate(out)


def halved(x: np.ndarray, rows: np.ndarray, source: np.ndarray, target: np.ndarray, passes: int = 12) -> np.ndarray:
    """Side (0 or 1) of each of the rows: halves of equal size with few edges between them."""
    own = x[rows] - x[rows].mean(0)
    direction = np.linalg.svd(own[:: max(1, len(own) // 512)], full_matrices=False)[2][0]
    side = np.zeros(len(rows), np.int8)
    side[np.argsort(own @ direction, kind="stable")[len(rows) // 2 :]] = 1
    place = np.full(len(x), -1)
    place[rows] = np.arange(len(rows))
    inside = (place[source] >= 0) & (place[target] >= 0)
    a, b = place[source[inside]], place[target[inside]]
    cut = np.count_nonzero(side[a] != side[b])
    for _ in range(passes):
        cross = (side[a] != side[b]) * 2 - 1
        gain = np.bincount(a, cross, len(rows)) + np.bincount(b, cross, len(rows))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = np.count_nonzero(gain[left[: len(right)]] + gain[right[: len(left)]] > 0)
        better = False
        while n:
            new = side.copy()
            new[left[:n]], new[right[:n]] = 1, 0
            if (now := np.count_nonzero(new[a] != new[b])) < cut:
                side, cut, better = new, now, True
                break
            n //= 2
        if not better:
            break
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row; parts (a power of two) differ in size by a row or so."""
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    part, groups = np.zeros(len(x), np.int64), [np.arange(len(x))]
    while len(groups) < parts:
        split = []
        for rows in groups:
            side = halved(x, rows, source, target) if len(rows) > 1 else np.zeros(len(rows), np.int8)
            split += [rows[side == 0], rows[side == 1]]
        groups = split
    for k, rows in enumerate(groups):
        part[rows] = k
    return part


class Router:
    """A one-hidden-layer classifier from vectors to parts."""

    def __init__(self, x: np.ndarray, parts: int, seed: int = 7, steps: int = 300):
        x = np.unique(x.astype(np.float32), axis=0)
        self.scale = np.float32(1 / max(1e-30, np.sqrt((x.astype(np.float64) ** 2).sum(1).mean())))
        x = x * self.scale
        rng = np.random.default_rng(seed)
        graph = neighbour_graph(x, GRAPH_NEIGHBOURS)
        part = balanced_parts(x, graph, parts)
        wanted = np.zeros((len(x), parts), np.float32)
        np.add.at(wanted, (np.arange(len(x)), part), 1)
        np.add.at(wanted, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
        wanted /= wanted.sum(1, keepdims=True)
        sizes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]
        self.w = [rng.normal(0, (2 / s[0]) ** 0.5 if len(s) == 2 else 0, s).astype(np.float32) for s in sizes]
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), min(512, len(x)))
            hidden = np.maximum(x[rows] @ self.w[0] + self.w[1], 0)
            p = self._softmax(hidden @ self.w[2] + self.w[3])
            d = (p - wanted[rows]) / len(rows)
            back = (d @ self.w[2].T) * (hidden > 0)
            for k, g in enumerate((x[rows].T @ back, back.sum(0), hidden.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = self.w[k] - np.float32(0.01 * (1 - step / (steps + 1))) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8).astype(np.float32)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, most probable first."""
        z = np.maximum((x * self.scale).astype(np.float32) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def _assigned(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.ranked(matrix(b.column(1)), 1)[:, 0] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b.column(0), b.column(1)], names=["part", "vec_id", "embedding"])

    return run


def _routed(router: Router, visited: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                part = router.ranked(matrix(b.column(1)), visited)
                rows = pa.array(np.repeat(np.arange(b.num_rows), part.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel().astype(np.int32)), b.column(0).take(rows), b.column(1).take(rows)], names=["part", "vec_id", "embedding"])

    return run


def nearest(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of each query's k nearest other ids; ties to smaller ids.

    Of several vectors of one id the nearest one counts.
    """
    order = np.argsort(vec_id, kind="stable")
    vec_id, v, out = vec_id[order], v[order].astype(np.float64), []
    alike = int(np.unique(vec_id, return_counts=True)[1].max(initial=1))
    for i in range(0, len(q), 256):
        own = q[i : i + 256].astype(np.float64)
        s = own @ v.T
        s[query_id[i : i + 256, None] == vec_id[None, :]] = -np.inf
        n = min(k * alike, s.shape[1])
        least = np.partition(s, -n, axis=1)[:, -n]
        # equal vectors must score equally wherever they stand, so the best are scored again, pair by pair
        row, col = np.nonzero((s >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None]) & (s > -np.inf))
        score = (own[row] * v[col]).sum(1)
        order = np.lexsort((vec_id[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        if alike > 1:
            once = np.sort(np.unique(row * (len(vec_id) + 1) + np.searchsorted(vec_id, vec_id[col]), return_index=True)[1])
            row, col, score = row[once], col[once], score[once]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        out.append((query_id[i + row[best]], vec_id[col[best]], score[best]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _compared(k: int):
    def run(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_numpy(zero_copy_only=False), bool)
        ids, x = group.column("vec_id").to_numpy(zero_copy_only=False), matrix(group.column("embedding"))
        if asks.any() and not asks.all():
            # equal rows are asked, and looked at, once
            bits = np.column_stack([ids, np.ascontiguousarray(x).view(np.int32 if x.dtype == np.float32 else np.int64)])
            own, others = (np.flatnonzero(m)[np.unique(bits[m], axis=0, return_index=True)[1]] for m in (asks, ~asks))
            a, b, s = nearest(ids[own], x[own], ids[others], x[others], k)
        else:
            a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    return run


def fit(rows: DataFrame, n: int) -> Router:
    """A router from a sample of at most SAMPLE rows, or SAMPLE_OF_PART for each part, chosen by a hash of vec_id."""
    parts = FEWEST
    while parts < MOST and parts * PART_ROWS < n:
        parts *= 2
    held = rows.orderBy(F.xxhash64("vec_id", F.lit("ann")), "vec_id", "embedding").select("embedding").limit(max(SAMPLE, SAMPLE_OF_PART * parts)).toArrow()
    return Router(matrix(held.column("embedding")).astype(np.float32), parts)


def _audited(router: Router, query_id: np.ndarray, q: np.ndarray, k: int):
    """Each batch's nearest rows of the audited queries, with the rows' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))
            if len(ids):
                a, v, s = nearest(query_id, q, ids, x, k)
                order = np.argsort(ids, kind="stable")
                part = router.ranked(x, 1)[:, 0][order[np.searchsorted(ids[order], v)]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(v), pa.array(s), pa.array(part.astype(np.int32))], names=["query_id", "vec_id", "score", "part"])

    return run


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _once(found: DataFrame) -> DataFrame:
    """The best score of each query and candidate."""
    others = [F.first(c).alias(c) for c in found.columns if c not in ("query_id", "vec_id", "score")]
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), *others)


def parts_to_visit(router: Router, rows: DataFrame, every: int, k: int, recall: float = RECALL) -> int:
    """The fewest parts with which audited queries reach the recall, and a sixteenth of all more."""
    parts = router.w[3].shape[0]
    held = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id", F.lit("audit")), "vec_id", "embedding").select("vec_id", "embedding").limit(AUDITED).collect()
    held = sorted({r.vec_id: r for r in held}.values(), key=lambda r: r.vec_id)
    if not held:
        return parts
    ids, q = np.array([r.vec_id for r in held]), np.array([r.embedding for r in held])
    best = _nearest_of(_once(rows.mapInArrow(_audited(router, ids, q, k), "query_id long, vec_id long, score double, part int")), k)
    order = router.ranked(q, parts)
    place = {i: {p: n for n, p in enumerate(o)} for i, o in zip(ids.tolist(), order.tolist(), strict=True)}
    depth = np.array([place[r.query_id][r.part] for r in best.select("query_id", "part").collect()])
    reached = np.cumsum(np.bincount(depth, minlength=parts)) / max(1, len(depth))
    return min(parts, int(np.searchsorted(reached, recall)) + 1 + parts // 16)


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: k nearest of the queries found, nearest first.

    Queries are the rows whose vec_id is divisible by ``every``; candidates
    are all rows with another vec_id, ties go to smaller ids. Scores are inner
    products of the original vectors in double precision. Vectors that are
    null, zero, not finite or not of the table's usual length, and rows with a
    null vec_id, take no part. Of several vectors of one vec_id the nearest
    one counts, as a query too. Other columns are ignored; without two usable
    rows the result is empty.
    """
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")))
    n = rows.count()
    schema = "query_id long, vec_id long, score double"
    if n < 2:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit(rows, n)
    parts = router.w[3].shape[0]
    dealt = rows.mapInArrow(_assigned(router), f"part int, vec_id long, embedding {kind}")
    visited = parts_to_visit(router, rows, every, k, recall)
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(_routed(router, visited), f"part int, vec_id long, embedding {kind}")
    # at most MOST rows: how many blocks of candidates and of queries each part has
    count = lambda df: {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
    have, want = count(dealt), count(asked)
    blocks = F.array(*[F.lit(max(1, -(-have.get(p, 0) // BLOCK_ROWS))) for p in range(parts)])
    asks = F.array(*[F.lit(max(1, -(-want.get(p, 0) // BLOCK_QUERIES))) for p in range(parts)])
    deal = lambda to: F.pmod(F.xxhash64("vec_id"), to[F.col("part")]).cast("int")
    every_one = lambda to: F.explode(F.sequence(F.lit(0), to[F.col("part")] - 1))
    left = dealt.select("part", deal(blocks).alias("block"), every_one(asks).alias("turn"), "vec_id", "embedding", F.lit(False).alias("asks"))
    right = asked.select("part", every_one(blocks).alias("block"), deal(asks).alias("turn"), "vec_id", "embedding", F.lit(True).alias("asks"))
    found = left.unionAll(right).groupBy("part", "block", "turn").applyInArrow(_compared(k), schema)
    return _nearest_of(_once(found), k).select("query_id", "rank", "vec_id", "score")

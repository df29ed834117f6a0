"""Learned partitions: parts, exactness of scores, recall against brute force."""

import numpy as np

from certus.llm.ann import balanced_parts, nearest, nearest_neighbours, neighbour_graph

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x.astype(np.float64)):
        if i % every == 0:
            s = (q * x.astype(np.float64)).sum(1)
            out[i] = sorted((-a, j) for j, a in zip(ids, s) if j != i)[:k]
    return out


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (100, 8)) + c for c in rng.normal(0, 3, (8, 8))]).astype(np.float32)
    graph = neighbour_graph(x, 6)
    part = balanced_parts(x, graph, 8)
    assert np.bincount(part, minlength=8).tolist() == [100] * 8
    chance = 7 / 8
    assert (part[graph] != part[:, None]).mean() < chance / 3


def test_nearest_with_ties():
    x = np.array([[1, 0], [1, 0], [0, 1], [1, 0], [0.5, 0.5]], np.float32)
    q, v, s = nearest(np.array([0, 8]), x[[0, 2]], np.array([8, 4, 2, 0, 6]), x, 3)
    assert list(zip(q.tolist(), v.tolist())) == [(0, 4), (0, 8), (0, 6), (8, 2), (8, 6), (8, 0)]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:600] = x[3]
    rows = [(i, v.tolist(), 0, "clash") for i, v in enumerate(x)]
    odd = [(2000, None, 0, ""), (2020, [0.0] * 16, 0, ""), (2040, [float("nan")] * 16, 0, ""), (2060, [1.0] * 3, 0, ""), (None, x[0].tolist(), 0, ""), (2080, [float("inf")] * 16, 0, "")]
    got = nearest_neighbours(spark.createDataFrame(rows + odd + rows[:40], SCHEMA).repartition(4)).collect()
    want = brute(range(1500), x, 20, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    hits = 0
    for i, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and len({r.vec_id for r in own}) == 20
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - float((x[i].astype(float) * x[r.vec_id].astype(float)).sum())) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & {j for _, j in want[i]})
    assert hits / (20 * len(want)) >= 0.9


def test_repeated_ids_and_double_vectors(spark):
    """Of several vectors of one id the nearest counts; doubles stay doubles."""
    rows = [(0, [1.0, 0.1], 0, ""), (0, [0.0, 1.0], 0, ""), (1, [0.5, 1e-9], 0, ""), (1, [0.0, 3.0], 0, ""), (2, [1.0, 0.0], 0, ""), (2, [1.0, 0.0], 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>"))
    assert [(r["rank"], r.vec_id, r.score) for r in nearest_neighbours(docs).orderBy("rank").collect()] == [(1, 1, 3.0), (2, 2, 1.0)]
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    ids = np.arange(90) // 2
    q, v, s = nearest(ids[:10], x[:10], ids, x, 7)
    for k in range(5):
        own = [(float(b), int(a)) for a, b in zip(v[q == k], s[q == k])]
        assert len(own) == 14  # a ranking for each vector of the query
    docs = spark.createDataFrame([(int(i), r.tolist(), 0, "") for i, r in zip(ids, x)], SCHEMA.replace("array<float>", "array<double>"))
    for r in nearest_neighbours(docs, k=44).collect():
        assert r.score == max(float((a * b).sum()) for a in x[ids == r.query_id] for b in x[ids == r.vec_id])


def test_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [0.5, 0.0], 1, ""), (2, [0.0, 2.0], 1, "")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest_neighbours(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert nearest_neighbours(few.limit(0)).count() == 0
    assert nearest_neighbours(few.limit(1)).count() == 0

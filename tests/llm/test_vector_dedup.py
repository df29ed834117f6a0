"""Near-duplicate vectors against all pairs; the graph against brute force."""

import uuid

import numpy as np
import pytest

from certus.llm import vector_dedup
from certus.llm.hnsw import SmallWorld
from certus.llm.vector_dedup import near_duplicate_vectors, unit

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows):
    ok = [i for i, (v, x, label) in enumerate(rows) if label is not None and x is not None and len(x) == 8 and np.isfinite(x).all() and np.any(x)]
    x = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98:
                links[i].add(j)
    root = [r[0] for r in rows]
    while True:
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
        if new == root:
            return sorted((rows[i][0], len(links[i]), root[i], rows[i][0] == root[i]) for i in range(len(rows)))
        root = new


def rows():
    rng, out = np.random.default_rng(4), []
    for i in range(160):
        out.append((i, rng.normal(size=8).astype(np.float32).tolist(), int(rng.integers(3))))
    for i in range(160, 300):
        _, x, label = out[int(rng.integers(160))]
        out.append((i, (np.array(x) * rng.choice([1, 2]) + rng.normal(0, rng.choice([0, 0.05, 0.2]), 8)).astype(np.float32).tolist(), label))
    base = np.array(out[7][1])
    for i in range(300, 420):
        out.append((i, (base + rng.normal(0, 0.02, 8)).astype(np.float32).tolist(), 1))
    out += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [1.0], 1), (504, out[3][1], None), (505, out[3][1], out[3][2]), (506, [float("inf")] * 8, 1), (507, [1e30] * 8, 2), (508, [1e-30] * 8, 2)]
    return out


def test_matches_all_pairs(spark):
    got = near_duplicate_vectors(spark.createDataFrame([(*r, "clash") for r in rows()], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows())


def test_many_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", 40)
    got = near_duplicate_vectors(spark.createDataFrame([(*r, "clash") for r in rows()], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows())


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (2, [1.0, 0.01], 0, ""), (None, [1.0, 0.0], 0, ""), (3, None, None, "")], SCHEMA)
    got = sorted(map(tuple, near_duplicate_vectors(docs).collect()), key=lambda x: (x[0] or 0, x))
    assert got == [(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert near_duplicate_vectors(docs.limit(0)).count() == 0
    assert [tuple(r) for r in near_duplicate_vectors(docs.where("vec_id = 3")).collect()] == [(3, 0, 3, True)]


def test_repeated_ids_of_different_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], 0, ""), (1, [0.0, 1.0], 0, ""), (2, [0.0, 1.0], 0, ""), (3, [1.0, 0.001], 0, "")], SCHEMA)
    assert sorted(map(tuple, near_duplicate_vectors(docs).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


@pytest.mark.parametrize("shard", [8192, 1100])
def test_thousands_of_one_label_go_through_the_graph(spark, monkeypatch, tmp_path, shard):
    """Against all pairs; every search leaves a file, so that the graph is seen to be asked for every vector."""
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", shard)
    rng = np.random.default_rng(shard)
    base = rng.normal(size=(2400, 24))
    near = base[rng.integers(0, 2400, 560)] + rng.normal(size=(560, 24)) * rng.choice([0.05, 0.12, 0.16], (560, 1))
    x = np.concatenate([base, near, base[:1] + rng.normal(size=(40, 24)) * 0.05]).astype(np.float32)
    u = unit(x)
    links = u @ u.T >= 0.98
    np.fill_diagonal(links, False)
    want, root = links.sum(1), np.arange(len(x))
    while True:
        new = np.array([min(root[i], *root[links[i]], root[i]) if links[i].any() else root[i] for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    search, folder = SmallWorld.search, str(tmp_path)

    def counted(self, q, beam):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(q)))
        return search(self, q, beam)

    least = vector_dedup.COSINE - vector_dedup.MARGIN
    monkeypatch.setattr(SmallWorld, "search", counted)
    graph = SmallWorld(u.astype(np.float32))
    r, c = vector_dedup.audited_links(graph, u.astype(np.float32), least)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) >= len(x)
    found = set(zip(r.tolist(), c.tolist()))
    assert all(pair in found for pair in zip(*map(np.ndarray.tolist, np.nonzero(links))))
    monkeypatch.setattr(SmallWorld, "search", search)
    docs = spark.createDataFrame([(i, v.tolist(), 5, "") for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(docs).collect()}
    assert got == {i: (int(want[i]), int(root[i])) for i in range(len(x))}


def test_audits_have_something_to_find_and_graphs_are_whole():
    rng = np.random.default_rng(8)
    x = unit(np.concatenate([rng.normal(size=(600, 16)), np.repeat(rng.normal(size=(6, 16)), 60, 0) + rng.normal(size=(360, 16)) * 1e-3])).astype(np.float32)
    graph = SmallWorld(x)
    asked = vector_dedup.probes(graph, 0.98, 128)
    best = (asked.astype(float) @ x.T).max(1)
    assert len(asked) == 128 and (best >= 0.98).all() and ((asked.astype(float) ** 2).sum(1) > 0.999).all()
    ids, _ = graph.search(x[:5], len(x))
    assert all(sorted(row) == list(range(len(x))) for row in ids.tolist())


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(3000, 16))).astype(np.float32)
    graph = SmallWorld(x)
    q = x[:300]
    ids, sims = graph.search(q, 64)
    top = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), top.tolist())]) > 0.95
    r, c = graph.near(q, 0.9)
    assert {(a, b) for a, b in zip(r.tolist(), c.tolist())} == set(zip(*map(list, np.nonzero(q @ x.T >= 0.9))))


def test_beams_stay_narrower_than_a_look_at_all(monkeypatch):
    """A graph that finds nothing fails every audit; then its vectors are compared, without beams as wide as itself."""
    rng = np.random.default_rng(6)
    x = unit(np.concatenate([rng.normal(size=(900, 16)), np.repeat(rng.normal(size=(3, 16)), 200, 0) + rng.normal(size=(600, 16)) * 1e-3])).astype(np.float32)
    graph, beams, search = SmallWorld(x), [], SmallWorld._search
    for k in graph.links:
        k[:] = -1
    monkeypatch.setattr(SmallWorld, "_search", lambda self, q, at, level, beam, also=-1: beams.append(beam) or search(self, q, at, level, beam, also))
    r, c = vector_dedup.audited_links(graph, x, 0.98)
    assert set(zip(r.tolist(), c.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.98)), strict=True))
    assert max(beams) ** 2 <= 4 * len(x)

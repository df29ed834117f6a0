"""Near-duplicate vectors: small-world graphs per shard, audits, verified links, components.

Equal vectors of a label are one row with a count. The rows of a label are
dealt to shards of bounded size; each shard gets a graph; each two shards of a
label query each other's. Beams widen until an audit passes: vectors made to
stand just within the bound of some of the graph's own, and some of the
queries, must have all their links found. Links are verified by the cosine in
double precision, and a task hands on only how many links each vector has and
a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.common import saved
from certus.llm.components import connected_components, spanning_links
from certus.llm.hnsw import SmallWorld
from certus.llm.vectors import matrix, usable

COSINE, SHARD_ROWS, AUDITED, FIRST_BEAM = 0.98, 8192, 128, 32
#: Single-precision similarities within this of the bound are verified.
MARGIN = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision and without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def verified(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return np.concatenate([((unit(x[i : i + 65536]) * unit(y[i : i + 65536])).sum(1) >= least) for i in range(0, len(x), 65536)] or [np.zeros(0, bool)])


def probes(graph: SmallWorld, least: float, n: int, seed: int = 3) -> np.ndarray:
    """Unit vectors that stand just within the bound of one of the graph's own vectors each."""
    rng = np.random.default_rng(seed)
    own = graph.x[np.unique(np.linspace(0, len(graph.x) - 1, min(n, len(graph.x))).astype(int))].astype(np.float64)
    side = rng.normal(size=own.shape)
    side -= own * (side * own).sum(1, keepdims=True)
    size = np.sqrt((side * side).sum(1, keepdims=True))
    near = least + 0.05 * (1 - least)
    return (near * own + np.sqrt(max(0.0, 1 - near * near)) * side / np.where(size > 1e-9, size, 1)).astype(np.float32)


def audited_links(graph: SmallWorld, q: np.ndarray, least: float, beam: int = FIRST_BEAM, audited: int = AUDITED) -> tuple[np.ndarray, np.ndarray]:
    """Query rows and ids at least that similar; the beam widens until no audited link is missed.

    Every probe has a link, to the vector it was made from, so an audit always
    has something to find. Where it takes a beam that is dearer than all of the
    graph's vectors, the queries are compared with those.
    """
    sample = np.unique(np.linspace(0, len(q) - 1, min(audited, len(q))).astype(int))
    asked = np.concatenate([probes(graph, least, audited), q[sample].astype(np.float32)])
    truth = asked @ graph.x.T >= least
    while True:
        r, c = graph.near(asked, least, beam)
        got = np.zeros_like(truth)
        got[r, c] = True
        if beam >= len(graph.x) or not (truth & ~got).any():
            return graph.near(q, least, beam)
        beam *= 2
        if graph.dear(beam):
            return graph.compared(q, least)


def _packed(group: pa.Table) -> pa.Table:
    """A shard as one row: ids, counts, vectors and the graph, in bytes."""
    group = group.sort_by([("vec_id", "ascending"), ("same", "ascending")])
    x = matrix(group.column("embedding"))
    graph = SmallWorld(unit(x).astype(np.float32))
    links = np.concatenate([k.ravel() for k in graph.links])
    return pa.table(
        {
            "label": group.column("label").slice(0, 1),
            "shard": group.column("shard").slice(0, 1),
            "ids": [group.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
            "same": [group.column("same").to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
            "counts": [group.column("n").to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
            "vectors": [x.astype("<f4").tobytes()],
            "links": [links.astype("<i4").tobytes()],
            "entry": pa.array([graph.entry], pa.int32()),
            "widths": pa.array([[k.shape[1] for k in graph.links]], pa.list_(pa.int32())),
            "entry_level": pa.array([graph.entry_level], pa.int32()),
        }
    )


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and hashes as pairs, counts and vectors of a shard."""
    ids, same, counts = (np.frombuffer(row[f"{side}_{k}"], "<i8") for k in ("ids", "same", "counts"))
    return np.column_stack([ids, same]), counts, np.frombuffer(row[f"{side}_vectors"], "<f4").reshape(len(ids), -1)


def _graph(row: dict, side: str, x: np.ndarray) -> SmallWorld:
    graph = SmallWorld.__new__(SmallWorld)
    graph.x, graph.entry, graph.entry_level = unit(x).astype(np.float32), row[f"{side}_entry"], row[f"{side}_entry_level"]
    flat, graph.links, at = np.frombuffer(row[f"{side}_links"], "<i4"), [], 0
    for width in row[f"{side}_widths"]:
        graph.links.append(flat[at : at + len(x) * width].reshape(len(x), width))
        at += len(x) * width
    return graph


def _linked(least: float):
    """For pairs of shards: (node, other, 0) for a forest of links, (node, null, n) for numbers of linked rows."""
    node = pa.struct([("vec_id", pa.int64()), ("same", pa.int64())])

    def nodes(pairs: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=list(node), mask=None if mask is None else pa.array(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                own, counts, x = _unpacked(row, "own")
                other, other_counts, q = _unpacked(row, "other")
                r, c = audited_links(_graph(row, "own", x), unit(q).astype(np.float32), least - MARGIN)
                if row["own_shard"] == row["other_shard"]:
                    r, c = np.minimum(r, c)[r != c], np.maximum(r, c)[r != c]
                else:
                    c2, r2 = audited_links(_graph(row, "other", q), unit(x).astype(np.float32), least - MARGIN)
                    r, c = np.r_[r, r2], np.r_[c, c2]
                r, c = np.divmod(np.unique(r * len(own) + c), len(own))
                ok = verified(q[r], x[c], least)
                r, c = r[ok], c[ok]
                every, at = np.unique(np.concatenate([other[r], own[c]]), axis=0, return_inverse=True)
                at = at.ravel()
                n = np.bincount(at, np.concatenate([counts[c], other_counts[r]]), len(every)).astype(np.int64)
                root = spanning_links(len(every), at[: len(r)], at[len(r) :])
                moved = np.flatnonzero(root != np.arange(len(every)))
                to = np.concatenate([every[root[moved]], every])
                none = np.r_[np.zeros(len(moved), bool), np.ones(len(every), bool)]
                yield pa.RecordBatch.from_arrays([nodes(np.concatenate([every[moved], every])), nodes(to, none), pa.array(np.concatenate([np.zeros(len(moved), np.int64), n]))], names=["a", "b", "n"])

    return run


def _shards(packed: DataFrame, side: str) -> DataFrame:
    return packed.select("label", "shards", *[F.col(c).alias(f"{side}_{c}") for c in packed.columns if c not in ("label", "shards")])


def near_duplicate_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Rows of one label (not null) link if their cosine, in double precision, is
    at least ``least``. Vectors that are null, zero, not finite or not of the
    table's usual length link with nothing and are their own component. Each
    row is a vector: rows that repeat a vec_id link like others, with each
    other too. A row with a null vec_id can't be named by a component: it
    links with nothing and is kept, its component_id null. Other columns are
    ignored.
    """
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = all_rows.where("vec_id is not null")
    good = usable(rows.where("label is not null")).withColumn("same", F.xxhash64("label", "embedding"))
    distinct = saved(good.groupBy("same", "label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")))
    sizes = distinct.groupBy("label").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"))
    dealt = distinct.join(sizes, "label").withColumn("shard", F.pmod("same", "shards").cast("int"))
    schema = "label string, shard int, ids binary, same binary, counts binary, vectors binary, links binary, entry int, widths array<int>, entry_level int"
    packed = dealt.select("label", "shard", "vec_id", "same", "n", "embedding").groupBy("label", "shard").applyInArrow(_packed, schema)
    packed = saved(packed.join(sizes, "label"))
    # every pair of shards has a key of its own, so a label with many isn't brought together
    own = _shards(packed, "own").withColumn("other_shard", F.explode(F.sequence("own_shard", F.col("shards") - 1))).drop("shards")
    other = _shards(packed, "other").withColumn("own_shard", F.explode(F.sequence(F.lit(0), "other_shard"))).drop("shards")
    pairs = own.join(other, ["label", "own_shard", "other_shard"])
    tasks = packed.agg(F.sum(F.col("shards") - F.col("shard"))).first()[0]
    node = "struct<vec_id: long, same: long>"
    linked = saved(pairs.repartition(max(1, min(4000, tasks or 1)), "label", "own_shard", "other_shard").mapInArrow(_linked(least), f"a {node}, b {node}, n long"))
    roots = connected_components(linked.where("b is not null").select("a", "b"))
    counts = linked.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    distinct = distinct.withColumn("node", F.struct("vec_id", "same"))
    told = distinct.join(counts.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    told = told.select("same", "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root.vec_id", "vec_id").alias("component_id"))
    linking = good.join(told, ["same", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    usual = good.select(F.size("embedding").alias("n")).first()
    fits = "vec_id is not null and label is not null and embedding is not null and size(embedding) = {n} and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    alone = all_rows.where(f"not coalesce({fits.format(n=usual['n'])}, false)") if usual else all_rows
    out = linking.unionAll(alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

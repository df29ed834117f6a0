"""Near copies: SimHash fingerprints by anchors first, then what fingerprints can't reach.

A text is the set of its five-word shingles (64-bit hashes), and two texts are
near copies if their sets' similarity is at least 4/5. Equal sets are one node
before any of this.

First, sets whose fingerprints differ in at most THRESHOLD of 64 bits meet.
The bits are cut into three blocks; two such fingerprints differ in at most a
third of the threshold in one of them, and there operator 10's covering
(anchors of the Golay code within radius plus threshold) brings them together.
Each set is linked with its nearest ones, and what links connect that the
whole sets confirm has one label. So pairs within large clusters of copies
aren't all written out.

Texts at similarity 4/5 may differ in more bits than any covering can bridge.
So that no such pair is missed, sets with different labels meet by prefixes:
with all shingles in one order, rare ones first, two sets that are similar
enough share a shingle among the first fifth (and one more) of each. All such
candidates are verified on the whole sets too. Where many sets share a shingle,
each is first held against a few of them only: what links then connect has one
label, and so the pairs of a large cluster aren't all written out. The last
round takes all pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.common import parts, saved
from certus.llm.components import connected_components
from certus.llm.simhash import LENGTH, RADIUS, SEED, anchors_of, majority

WORDS = 5
#: Bits in which candidates may differ, in all and in the block that brings them together.
THRESHOLD, SLACK = 11, 3
#: First bit and number of bits of the blocks.
BITS = ((0, LENGTH), (LENGTH, LENGTH), (2 * LENGTH, 64 - 2 * LENGTH))
#: Anchors of a block; residents and guests of an anchor that meet in one cell.
ANCHORS, RESIDENTS, GUESTS = 4096, 4096, 1 << 18
#: Nearest sets that the first search links a set to, besides the smallest node.
NEAREST = 2
#: Sets that fill one group of cells.
GROUP_SETS = 50_000
#: Bits that mark wanted documents (wrongly marked ones cost time only), and pieces in which arrays are merged.
MARKS, PIECES = 1 << 22, 64
#: Classes of sizes within the factor 5/4, which similar sets keep to.
CLASSES = 8

#: Counters of shingles, which order them.
COUNTERS = 1 << 18
#: Prefix rows that one sorted partition should hold; labels that are broadcast (more are joined by a shuffle).
PREFIX_ROWS, LABELS = 2_000_000, 1_000_000
#: Sets of other labels that a set is held against at one shingle, round by round; None: all.
ROUNDS = (16, None)

TABLE = np.dtype([("node", "<i8"), ("fp", "<u8"), ("size", "<u2")])
ENTRY = np.dtype([("cell", "<u4"), ("row", "<u2")])
#: Columns of candidates, and of rows that wait for the next round.
NAMES = ["gram", "node", "b", "n", "place"]


#: Bytes that part words, and a number for each byte at each place of a word of up to LONGEST bytes.
GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LONGEST = 256
#: Words whose bytes are looked up at once.
BLOCK_WORDS = 1 << 16


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number scattered over all of them, one to one."""
    # shifts and factors are the fixed values of SplitMix64
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


@cache
def _bytes_at_places() -> np.ndarray:
    return _mixed(np.arange(1, LONGEST * 256 + 1, dtype=np.uint64))


def _words_hashed(text: str | None) -> np.ndarray:
    """A hash of each word: the sum of its bytes' numbers; of longer words XXH64."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = GAPS[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    start, end = edges[::2], edges[1::2]
    out = np.zeros(len(start), np.uint64)
    for at in range(0, len(start), BLOCK_WORDS):
        own = slice(at, at + BLOCK_WORDS)
        size = end[own] - start[own]
        lo, hi = start[own][0], end[own][-1]
        body = raw[lo:hi][~gap[lo:hi]]
        first = np.cumsum(size) - size
        place = np.arange(len(body)) - np.repeat(first, size) & LONGEST - 1
        out[own] = np.add.reduceat(_bytes_at_places()[place * 256 + body], first)
    for i in np.flatnonzero(end - start > LONGEST):
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes(), SEED)
    return _mixed(out)


def grams_of(text: str | None) -> np.ndarray:
    """The different shingles' hashes, sorted; fewer than WORDS words are one shingle."""
    w = _words_hashed(text)
    if not len(w):
        return w
    many = min(WORDS, len(w))
    h = np.zeros(len(w) - many + 1, np.uint64)
    for k, factor in enumerate(_bytes_at_places()[:many] | np.uint64(1)):
        h += w[k : k + len(h)] * factor
    # numpy's own unique hashes such numbers, which takes longer than sorting them
    h = np.sort(_mixed(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def _node(grams: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [(_node(g), len(g), majority(g)) for g in (grams_of(t.as_py()) for t in b.column(1))]
        fp = np.array([f for *_, f in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, *_ in sets], pa.int64()), pa.array([n for _, n, _ in sets], pa.int32()), pa.array(fp)], names=["doc_id", "node", "n", "fp"])


def _pieces(array: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([c.tobytes() for c in np.split(array, PIECES)], pa.binary())], names=["piece", "content"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(MARKS, bool)
    for b in batches:
        marks[_slots(b.column(0).to_numpy())] = True
    yield _pieces(np.packbits(marks))


def _slots(ids: np.ndarray) -> np.ndarray:
    return (ids.view(np.uint64) % np.uint64(MARKS)).view(np.int64)


def _words(fp: np.ndarray, block: int) -> np.ndarray:
    first, width = BITS[block]
    return fp >> np.uint64(first) & np.uint64((1 << width) - 1)


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Guests of each anchor, and behind them residents."""
    count = np.zeros(2 * len(BITS) * ANCHORS, np.int64)
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), 2048):
            for block in range(len(BITS)):
                _, anchor, far = anchors_of(_words(fp[at : at + 2048], block), RADIUS + SLACK)
                count[block * ANCHORS : (block + 1) * ANCHORS] += np.bincount(anchor, minlength=ANCHORS)
                here = len(BITS) * ANCHORS + block * ANCHORS
                count[here : here + ANCHORS] += np.bincount(anchor[far <= RADIUS], minlength=ANCHORS)
    yield _pieces(count)


def gathered(rows: DataFrame, made, merged: np.ufunc, dtype: type) -> np.ndarray:
    """The arrays of all tasks, merged by a ufunc; their length doesn't depend on the data."""

    def merge(group: pa.Table) -> pa.Table:
        total = merged.reduce([np.frombuffer(c.as_buffer(), dtype) for c in group.column("content")])
        return pa.table({"piece": group.column("piece").slice(0, 1), "content": pa.array([total.astype(dtype).tobytes()], pa.binary())})

    pieces = rows.mapInArrow(made, "piece int, content binary").groupBy("piece").applyInArrow(merge, "piece int, content binary").collect()
    if not pieces:
        return np.concatenate([np.frombuffer(c.as_buffer(), dtype) for c in next(made(iter([]))).column(1)])
    return np.concatenate([np.frombuffer(r.content, dtype) for r in sorted(pieces, key=lambda r: r.piece)])


class Grid:
    """Cells in which an anchor's residents and guests meet, each dealt to as many parts as their number asks for."""

    def __init__(self, count: np.ndarray):
        anchors = len(BITS) * ANCHORS
        self.guests = np.maximum(1, -(-count[:anchors] // GUESTS))
        self.residents = np.maximum(1, -(-count[anchors : 2 * anchors] // RESIDENTS))
        self.first = np.r_[0, np.cumsum(self.guests * self.residents)]

    def placed(self, fp: np.ndarray, node: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, rows and whether resident there, of all sets in one block."""
        row, anchor, far = anchors_of(_words(fp, block), RADIUS + SLACK)
        anchor = anchor + block * ANCHORS
        out = []
        for home in (False, True):
            at = np.flatnonzero(far <= RADIUS) if home else np.arange(len(row))
            r, a = row[at], anchor[at]
            q, p = self.guests[a], self.residents[a]
            part = (node[r].view(np.uint64) % (p if home else q).astype(np.uint64)).astype(np.int64)
            times = q if home else p
            which = np.repeat(np.arange(len(r)), times)
            other = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            i, j = (part[which], other) if home else (other, part[which])
            out.append((self.first[a[which]] + i * q[which] + j, r[which], np.full(len(which), home)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _covered(grid: Grid, groups: int):
    """For each slice of sets and group of cells: the sets that go there, and the cells that each goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                node, n, fp = (c.to_numpy() for c in whole.slice(at, 2048).columns)
                table = np.zeros(len(node), TABLE)
                table["node"], table["fp"] = node, fp.view(np.uint64)
                table["size"] = np.log(n) / np.log(1.25) * CLASSES
                cell, row, home = (np.concatenate(c) for c in zip(*(grid.placed(table["fp"], node, k) for k in range(len(BITS))), strict=True))
                group = cell % groups
                order = np.argsort(group, kind="stable")
                cell, row, home, group = cell[order], row[order], home[order], group[order]
                cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, int)
                out = []
                for s, e in zip(cuts, cuts[1:], strict=False):
                    used, place = np.unique(row[s:e], return_inverse=True)
                    entry = np.zeros(e - s, ENTRY)
                    entry["cell"], entry["row"] = cell[s:e], place | home[s:e].astype(np.int64) << 15
                    out.append((int(group[s]), table[used].tobytes(), entry.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "sets", "entries"])

    return run


def _nearest(resident: np.ndarray, guest: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of candidates: those that link a resident with its nearest guests and with the smallest node."""
    keep = np.zeros(len(resident), bool)
    for keys, most in ((guest["node"], far, resident["node"]), NEAREST), ((guest["node"], resident["node"]), 1):
        order = np.lexsort(keys)
        own = resident["node"][order]
        new = np.r_[True, own[1:] != own[:-1]]
        rank = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        keep[order[rank < most]] = True
    return keep


def _compared(group: pa.Table) -> pa.Table:
    """Compares the guests of each cell with its residents, as far as sizes allow; a, b: each resident's nearest."""
    tables = [np.frombuffer(x.as_buffer(), TABLE) for x in group.column("sets")]
    entries = [np.frombuffer(x.as_buffer(), ENTRY) for x in group.column("entries")]
    shift = np.repeat(np.cumsum([0, *map(len, tables)])[:-1], [len(x) for x in entries])
    sets, entry = np.concatenate(tables), np.concatenate(entries)
    row, home = (entry["row"] & 0x7FFF) + shift, entry["row"] >> 15
    order = np.lexsort((sets["size"][row], home, entry["cell"]))
    cell, row, home = entry["cell"][order], row[order], home[order]
    cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    a, b = [], []
    for s, e in zip(cuts, cuts[1:], strict=False):
        split = s + int(np.searchsorted(home[s:e], 1))
        guests, residents = sets[row[s:split]], sets[row[split:e]]
        step = max(1, min(256, (1 << 20) // max(1, len(guests))))
        for i in range(0, len(residents), step):
            own = residents[i : i + step]
            lo = np.searchsorted(guests["size"], max(0, int(own["size"][0]) - CLASSES - 1))
            hi = np.searchsorted(guests["size"], int(own["size"][-1]) + CLASSES + 1, side="right")
            near = guests[lo:hi]
            far = np.bitwise_count(own["fp"][:, None] ^ near["fp"][None, :])
            x, y = np.nonzero(far <= THRESHOLD)
            apart = own["node"][x] != near["node"][y]
            x, y = x[apart], y[apart]
            if len(x):
                keep = _nearest(own[x], near[y], far[x, y])
                a.append(own["node"][x[keep]])
                b.append(near["node"][y[keep]])
    a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def neighbours(nodes: DataFrame, groups: int) -> DataFrame:
    """a, b (a < b): each set with the nearest of those within the threshold; nodes: node, n, fp."""
    grid = Grid(gathered(nodes.select("fp"), _crowds, np.add, np.int64))
    covered = nodes.select("node", "n", "fp").mapInArrow(_covered(grid, groups), "bucket int, sets binary, entries binary")
    return covered.repartition(groups, "bucket").groupBy("bucket").applyInArrow(_compared, "a long, b long").distinct()


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(COUNTERS)).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for t in b.column(0):
            np.add.at(count, _counters(grams_of(t.as_py())), 1)
    yield _pieces(count)


def _prefixes(count: np.ndarray):
    """Each set's first fifth of shingles and one more: gram, node, the set's size, place in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                sets = [grams_of(t.as_py()) for t in whole.column(0).slice(at, 512)]
                size = np.array([len(g) for g in sets], np.int32)
                first = np.where(size > 0, size // 5 + 1, 0)
                grams = [g[np.argsort(count[_counters(g)], kind="stable")[:k]] for g, k in zip(sets, first.tolist(), strict=True)]
                place = np.concatenate([np.arange(k) for k in first.tolist()]).astype(np.int32)
                columns = [np.concatenate(grams).view(np.int64), np.repeat(np.array([_node(g) for g in sets], np.int64), first), np.repeat(size, first), place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "node", "n", "place"])

    return run


def _paired(few: int | None):
    """Of rows sorted by gram, label and node: pairs of nodes of two labels that share a gram and may be similar enough.

    Each row with few others at most, spread over those behind it, and with
    the few that have the gram first, which are the least changed of a
    cluster. Rows of a gram that has more pairs come back as they are, without b.
    """

    def similar(node: np.ndarray, n: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        # both bounds hold at the first gram that two similar sets share
        near = (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])) & (9 * np.minimum(n[x] - place[x], n[y] - place[y]) >= 4 * (n[x] + n[y]))
        a, b = node[x[near]], node[y[near]]
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            none, zero = pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.int32())
            yield pa.RecordBatch.from_arrays([none, pa.array(both[:, 0]), pa.array(both[:, 1]), zero, zero], names=NAMES)

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, label, node = rows[:3]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])]
        gram, label, node, n, place = (c[new] for c in rows)
        last = np.r_[gram[1:] != gram[:-1], True]
        ends = np.flatnonzero(last) + 1
        runs = np.flatnonzero(np.r_[(gram[1:] != gram[:-1]) | (label[1:] != label[:-1]), True]) + 1
        here = np.arange(len(gram))
        begin = runs[np.searchsorted(runs, here, side="right")]
        behind = ends[np.searchsorted(ends, here, side="right")] - begin
        count, start = behind, np.zeros(len(gram), np.int64)
        first = np.r_[0, ends[:-1]]
        if few is not None and (behind > few).any():
            count = np.minimum(behind, few)
            start = (_mixed((gram ^ node).view(np.uint64)) % np.maximum(1, behind).astype(np.uint64)).view(np.int64)
            group = np.repeat(np.arange(len(first)), ends - first)
            crowded = (np.maximum.reduceat(behind, first) > few)[group]
            left = [c[crowded] for c in (gram, node, n, place)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, left[:2]), pa.nulls(len(left[0]), pa.int64()), *map(pa.array, left[2:])], names=NAMES)
        n, place = n.astype(np.int64), place.astype(np.int64)
        if few is not None and (behind > few).any():
            least, x = np.lexsort((node, place, group)), np.flatnonzero(crowded)
            for k in range(few):
                y = least[first[group[x]] + k]
                apart = label[x] != label[y]
                yield from similar(node, n, place, x[apart], y[apart])
        total = np.r_[0, np.cumsum(count)]
        for lo in range(0, int(total[-1]), 1 << 18):
            at = np.arange(lo, min(lo + (1 << 18), int(total[-1])))
            x = np.searchsorted(total, at, side="right") - 1
            y = begin[x] + (start[x] + (at - total[x]) * behind[x] // count[x]) % behind[x]
            yield from similar(node, n, place, x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            rows = [c.to_numpy() for c in b.columns]
            if not len(rows[0]):
                continue
            # the last gram's rows wait for the next batch
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if held and held[0][0][0] != rows[0][-1]:
                yield from pairs([np.concatenate(c) for c in zip(*held, [c[:last] for c in rows], strict=True)])
                held = []
            elif last:
                yield from pairs([c[:last] for c in rows])
            held.append([c[last:] for c in rows])
        if held:
            yield from pairs([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def prefixes(texts: DataFrame) -> DataFrame:
    """gram, node, n, place: the first fifth of each set's shingles and one more, rare ones first."""
    return texts.mapInArrow(_prefixes(gathered(texts, _counted, np.add, np.int64)), "gram long, node long, n int, place int")


def across_labels(rows: DataFrame, labels: DataFrame, groups: int, few: int | None) -> DataFrame:
    """Candidates with different labels among the rows of prefixes: node and b (node < b).

    With few, a row is held against so many others at most; the rows of grams
    that this cuts short come back too, with gram, n and place and without b.
    labels: node, root of the sets that have a label other than themselves.
    """
    known = F.broadcast(labels) if labels.count() <= LABELS else labels
    rows = rows.join(known, "node", "left").select("gram", F.coalesce("root", "node").alias("label"), "node", "n", "place")
    return rows.repartition(groups, "gram").sortWithinPartitions("gram", "label", "node").mapInArrow(_paired(few), "gram long, node long, b long, n int, place int").distinct()


def _sketch(grams: np.ndarray) -> bytes:
    """How many of the grams end in each pattern of bits, about four each; empty where a byte doesn't hold the number."""
    k = 1 << max(3, (len(grams) // 4).bit_length() - 1)
    count = np.bincount((grams & np.uint64(k - 1)).view(np.int64), minlength=k)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def _may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without the pairs whose sketches leave no room for enough common grams."""
    for b in batches:
        keep = []
        for g, h in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint8).astype(np.int64) for v in (g, h))
            k = min(len(x), len(y))
            keep.append(not k or 9 * np.minimum(x.reshape(-1, k).sum(0), y.reshape(-1, k).sum(0)).sum() >= 4 * (x.sum() + y.sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _wanted(marks: np.ndarray):
    """node, grams and sketch of the texts whose doc_id falls on a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.unpackbits(marks).view(bool)
        for b in batches:
            texts = b.column(1).filter(pa.array(here[_slots(b.column(0).to_numpy())]))
            grams = [grams_of(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_node(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array([_sketch(g) for g in grams], pa.binary())], names=["node", "grams", "sketch"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for g, h in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(g.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64)
            keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets are similar enough.

    Shingles are made anew from the texts: stored, they take more room than
    the texts. Sketches of the sets rule out most false candidates before whole
    sets are brought together.
    """
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first"), "node"))
    held = texts.mapInArrow(_wanted(gathered(wanted.select("first"), _marked, np.bitwise_or, np.uint8)), "node long, grams binary, sketch binary")
    held = saved(held.join(wanted, "node", "left_semi").dropDuplicates(["node"]))

    def beside(pairs: DataFrame, what: str) -> DataFrame:
        left, right = (held.select(F.col("node").alias(k), F.col(what).alias(f"{k}_{what}")) for k in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", f"a_{what}", f"b_{what}")

    likely = saved(beside(pairs, "sketch").mapInArrow(_may_be, "a long, b long"))
    return saved(beside(likely, "grams").mapInArrow(_alike, "a long, b long"))


def similar_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links a, b of similar sets that connect all that such links connect.

    texts: doc_id, text; nodes: node, n, fp and first, the smallest doc_id.
    """
    size = nodes.agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).first()
    groups = max(64, 2 * parts(texts.sparkSession), size.sets // GROUP_SETS)
    links = verified(texts, nodes, saved(neighbours(nodes.where("n > 0"), groups)))
    rows, groups = prefixes(texts.select("text")), max(parts(texts.sparkSession), (size.grams or 0) // (5 * PREFIX_ROWS))
    tried = None
    for few in ROUNDS:
        labels = connected_components(links).select("node", "root")
        found = saved(across_labels(rows, labels, groups, few))
        pairs = found.where("b is not null").select(F.col("node").alias("a"), "b")
        pairs = saved(pairs.join(tried, ["a", "b"], "left_anti")) if tried else pairs
        tried = tried.unionByName(pairs) if tried else pairs
        links = saved(links.unionByName(verified(texts, nodes, pairs)))
        rows = found.where("b is null").select("gram", "node", "n", "place")
        if few is None or rows.isEmpty():
            return links


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first (smallest doc_id) of their component of near copies; all columns kept.

    A null text is an empty one; texts without words are equal. A text of
    fewer than five words is one shingle. Rows that repeat a doc_id are one
    document. Rows whose doc_id is null are kept.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = saved(rows.mapInArrow(_sets, "doc_id long, node long, n int, fp long"))
    groups = max(64, 2 * parts(docs.sparkSession), sets.count() // GROUP_SETS)
    nodes = saved(sets.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp")).repartition(groups))
    x, y = (nodes.select(F.col("node").alias(k), F.col("first").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    links = similar_sets(rows, nodes).join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
    copies = sets.select("doc_id", "node").join(nodes.select("node", "first"), "node").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    roots = connected_components(saved(links.unionByName(copies)))
    gone = roots.where("node <> root").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)

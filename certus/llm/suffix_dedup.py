"""Removal of text that earlier documents hold, found by sorting suffixes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a
document with a smaller doc_id. Suffixes of the whole corpus can't be sorted
in one place, and most of them meet no other. So suffixes are sorted where
repeats can be, in tasks of bounded size:

1. Anchors: in every window the places whose ``ANCHOR``-byte string hashes
   lowest are anchors, so equal windows have the same ones. Chunks of
   documents send the keys of their anchors to buckets, which answer which of
   them other documents have too.
2. Around each shared anchor a chunk cuts the context that windows over it can
   cover, and sends every different context once, with its smallest doc_id.
3. A bucket sorts the suffixes that begin at its anchors (see suffixes.py; the
   symbols are the anchor and the bytes that follow it, two at a time) and, as
   strings, what stands before the anchors, read backwards. Runs of common
   prefixes in both orders are the groups of equal windows; each learns its
   smallest doc_id.
4. Chunks turn the answers into spans.

What passes between chunks and buckets is one row per pair of them, so a
passage that a third of all documents hold is sent once by each chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.common import chunk_count
from certus.llm.suffixes import suffix_order

WINDOW, ANCHOR = 50, 24
#: Anchors that a window may have, which is also the number of offsets of windows over an anchor.
REACH = WINDOW - ANCHOR + 1
BEFORE = REACH - 1
#: Stands for no document, and for the doc_id of a row that has none.
NONE = np.iinfo(np.int64).max
PIECE = 1 << 15
#: Contexts whose suffixes are sorted together.
SORTED = 4096
_MIX = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """Minimum or maximum of every run of width values."""
    span = 1
    while 2 * span <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the anchors of a few documents that stand side by side."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, span, factor = _MIX[data], 1, int(_FACTOR)
    held = {}
    while span <= ANCHOR:
        held[span] = h
        if 2 * span > ANCHOR:
            break
        h = h[:-span] * np.uint64(pow(factor, span, 1 << 64)) + h[span:]
        span *= 2
    rest = ANCHOR - span
    while rest:
        part = max(s for s in held if s <= rest)
        tail = held[part][span:]
        h = h[: len(tail)] * np.uint64(pow(factor, part, 1 << 64)) + tail
        span, rest = span + part, rest - part
    h = h ^ (h >> np.uint64(31))
    h *= _SPREAD
    low = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(low, REACH, np.minimum)  # by start of window
    ends, lengths = bounds[1:], np.diff(bounds)
    across = ends[:, None] - 1 - np.arange(WINDOW - 1)[None, :]
    across = across[np.arange(WINDOW - 1)[None, :] < lengths[:, None]]
    least[across[across < len(least)]] = 0
    edge = np.zeros(REACH - 1, np.uint32)
    most = _sliding(np.concatenate([edge, least, edge]), REACH, np.maximum)
    at = np.flatnonzero(most == low)
    return at, h[at] * _FACTOR


class Chunk:
    """Some documents' bytes one after another, with their anchors."""

    def __init__(self, docs: pa.Table):
        order = docs.select(["doc_id", "text"]).add_column(0, "row", pa.array(np.arange(docs.num_rows)))
        self.order = order.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("row", "ascending")]).column("row").to_numpy()
        texts = docs.column("text").take(pa.array(self.order)).cast(pa.binary()).combine_chunks()
        ids = docs.column("doc_id").take(pa.array(self.order)).to_pylist()
        self.ids = np.array([NONE if i is None else i for i in ids], np.int64)
        parts = [t.as_py() or b"" for t in texts]
        self.text = b"".join(parts)
        self.data = np.frombuffer(self.text, np.uint8)
        self.bounds = np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]

    def anchors(self) -> None:
        places, keys, first = [], [], 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.bounds, self.bounds[first] + PIECE, side="right")) - 1)
            lo, hi = self.bounds[first], self.bounds[last]
            at, key = _anchors(self.data[lo:hi], self.bounds[first : last + 1] - lo)
            places.append(at + lo)
            keys.append(key)
            first = last
        self.place = np.concatenate(places) if places else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.bounds, self.place, side="right") - 1
        self.keys, self.of = np.unique(key, return_inverse=True)
        own = self.ids[self.doc]
        low, high = np.full(len(self.keys), NONE), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, own)
        np.maximum.at(high, self.of, own)
        self.several = low != high

    def slices(self, keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
        """Bucket and range of ascending keys, for buckets that have any."""
        bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        return [(b, int(s), int(e)) for b, (s, e) in enumerate(zip(edges, edges[1:], strict=False)) if e > s]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _ask(buckets: int):
    """Chunk to buckets: the low half of every different key, and whether two documents here have it."""

    def run(docs: pa.Table) -> pa.Table:
        chunk = Chunk(docs)
        chunk.anchors()
        number = docs.column("chunk")[0].as_py()
        low = (chunk.keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows = [(b, number, low[s:e].tobytes(), np.packbits(chunk.several[s:e]).tobytes()) for b, s, e in chunk.slices(chunk.keys, buckets)]
        return _table(rows, ["bucket", "chunk", "keys", "several"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Bucket to chunks: which of a chunk's keys more than one document has."""
    keys = [np.frombuffer(k.as_py(), "<u4") for k in rows.column("keys")]
    n = [len(k) for k in keys]
    several = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=k) for m, k in zip(rows.column("several"), n, strict=True)]).astype(bool)
    all_keys = np.concatenate(keys)
    order = np.argsort(all_keys, kind="stable")
    ranked = all_keys[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    group = np.cumsum(first) - 1
    common = (np.bincount(group) > 1) | (np.bincount(group, several[order]) > 0)
    mask = np.empty(len(all_keys), bool)
    mask[order] = common[group]
    edges = np.r_[0, np.cumsum(n)]
    out = [(c, b, np.packbits(mask[s:e]).tobytes()) for c, b, s, e in zip(rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist(), edges, edges[1:], strict=False)]
    return _table(out, ["chunk", "bucket", "mask"], [pa.int32(), pa.int32(), pa.binary()])


def contexts_at(chunk: Chunk, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of BEFORE + WINDOW bytes around places (zero outside the document), then the bytes before and from the place."""
    before = np.minimum(place - chunk.bounds[doc], BEFORE)
    after = np.minimum(chunk.bounds[doc + 1] - place, WINDOW)
    out = np.zeros((len(place), BEFORE + WINDOW + 2), np.uint8)
    column = np.arange(-BEFORE, WINDOW)
    for i in range(0, len(place), 1 << 16):
        s = slice(i, i + (1 << 16))
        inside = (column[None, :] >= -before[s, None]) & (column[None, :] < after[s, None])
        at = np.where(inside, place[s, None] + column[None, :], 0)
        out[s, :-2] = np.where(inside, chunk.data[at], 0)
    out[:, -2], out[:, -1] = before, after
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every different row, and for each row the number of its like."""
    rows = np.ascontiguousarray(rows)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, at, of = np.unique(rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return at, of


def _contexts(buckets: int):
    """Chunk and its answers to: contexts for buckets, and for itself the anchors' places and contexts.

    Both kinds of rows travel in one exchange, to a bucket's number or to the chunk's own.
    """

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["to", "bucket", "chunk", "contexts", "least", "places", "numbers"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        if not docs.num_rows:
            return _table([], names, kinds)
        chunk = Chunk(docs)
        chunk.anchors()
        number = docs.column("chunk")[0].as_py()
        said = dict(zip(answers.column("bucket").to_pylist(), answers.column("mask").to_pylist(), strict=True))
        shared = np.zeros(len(chunk.keys), bool)
        for b, s, e in chunk.slices(chunk.keys, buckets):
            shared[s:e] = np.unpackbits(np.frombuffer(said[b], np.uint8), count=e - s)
        at = np.flatnonzero(shared[chunk.of])
        place, doc, key = chunk.place[at], chunk.doc[at], chunk.keys[chunk.of[at]]
        around = contexts_at(chunk, place, doc)
        # a key's bytes come first, so that contexts stand in the order of their buckets
        keyed = np.hstack([key.astype(">u8").view(np.uint8).reshape(-1, 8), around])
        first, of = distinct_rows(keyed)
        least = np.full(len(first), NONE)
        np.minimum.at(least, of, chunk.ids[doc])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        rows = [(b, b, number, squeeze(around[first[s:e]].tobytes()), least[s:e].astype("<i8").tobytes(), None, None) for b, s, e in chunk.slices(key[first], buckets)]
        rows.append((number, None, number, None, None, place.astype("<i8").tobytes(), of.astype("<i8").tobytes()))
        return _table(rows, names, kinds)

    return run


def _runs(order: np.ndarray, rows: np.ndarray, cluster: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each row with the one before it in an order; -1 where another cluster begins."""
    out = np.full(len(order), -1)
    for i in range(1, len(order), 1 << 16):
        j = min(len(order), i + (1 << 16))
        differ = rows[order[i:j]] != rows[order[i - 1 : j - 1]]
        out[i:j] = np.where(differ.any(1), differ.argmax(1), most)
    out[1:][cluster[order[1:]] != cluster[order[:-1]]] = -1
    return out


def numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like distinct_rows, in the order in which the different rows come; rows are hashed and not sorted."""
    rows = np.ascontiguousarray(rows)
    kind = pa.binary(rows.shape[1])
    of = pa.Array.from_buffers(kind, len(rows), [None, pa.py_buffer(rows)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.full(int(of.max(initial=-1)) + 1, len(rows))
    np.minimum.at(first, of, np.arange(len(rows)))
    return first, of


def anchor_order(after: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Rows in the order of the suffixes that begin at their anchors, cluster by cluster.

    The suffixes are those of one text: a symbol for each cluster's anchor,
    the bytes after it two at a time, and an end that is less than all of them.
    Rows that are alike have the same suffix, which is sorted once. Whole
    clusters of about SORTED rows make up a text.
    """
    out, by = [], np.argsort(cluster, kind="stable")
    edges = np.r_[np.flatnonzero(np.r_[True, cluster[by][1:] != cluster[by][:-1]]), len(by)] if len(by) else np.zeros(1, np.int64)
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + SORTED, side="right")) - 1)
        rows = by[edges[at] : edges[to]]
        first, of = numbered(np.hstack([cluster[rows].astype(">u4").view(np.uint8).reshape(-1, 4), after[rows, ANCHOR:]]))
        units = np.ascontiguousarray(after[rows[first], ANCHOR:]).view(">u2").astype(np.int64)
        anchor = cluster[rows[first]] - cluster[rows[0]] + (1 << 16) + 1
        text = np.column_stack([anchor, units + 1, np.zeros(len(first), np.int64)])
        order = np.array(suffix_order(text.ravel().tolist()), np.int64)
        place = np.empty(len(first), np.int64)
        place[order[order % text.shape[1] == 0] // text.shape[1]] = np.arange(len(first))
        out.append(rows[np.argsort(place[of], kind="stable")])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def least_by_offset(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For contexts with their smallest doc_id: the smallest of each window over the anchor.

    Column o is for the window that begins o bytes before the anchor; NONE
    where the document has no such window.
    """
    before, after = rows[:, -2].astype(int), rows[:, -1].astype(int)
    offsets = np.arange(REACH)
    valid = (offsets[None, :] <= before[:, None]) & (WINDOW - offsets[None, :] <= after[:, None])
    out = np.where(valid, least[:, None], NONE)
    _, cluster = distinct_rows(rows[:, BEFORE : BEFORE + ANCHOR])
    many = np.flatnonzero(np.bincount(cluster)[cluster] > 1) if len(rows) else np.zeros(0, np.int64)
    if not len(many):
        return out
    cluster = np.unique(cluster[many], return_inverse=True)[1]
    right = np.ascontiguousarray(rows[many, BEFORE:-2])
    left = np.ascontiguousarray(rows[many, BEFORE - 1 :: -1]) if BEFORE else rows[many, :0]
    by_right = anchor_order(right, cluster)
    _, rank = distinct_rows(np.hstack([cluster.astype(">u4").view(np.uint8).reshape(-1, 4), left]))
    by_left = np.argsort(rank, kind="stable")
    common_right, common_left = _runs(by_right, right, cluster, WINDOW), _runs(by_left, left, cluster, BEFORE)
    run_right, run_left = np.empty(len(many), np.int64), np.empty(len(many), np.int64)
    for o in range(REACH):
        run_right[by_right] = np.cumsum(common_right < WINDOW - o)
        run_left[by_left] = np.cumsum(common_left < o)
        own = np.flatnonzero(valid[many, o])
        key = run_right[own] * (len(many) + 1) + run_left[own]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(own) else np.zeros(0, np.int64)
        if len(own):
            low = np.minimum.reduceat(least[many[own[order]]], first)
            out[many[own[order]], o] = np.repeat(low, np.diff(np.r_[first, len(own)]))
    return out


def packed_least(least: np.ndarray) -> bytes:
    """Smallest doc_ids by offset, as differences between offsets, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(least, axis=1, prepend=0).T.astype("<i8").tobytes())


def unpacked_least(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(REACH, -1).T, axis=1)


def _sorted(rows: pa.Table) -> pa.Table:
    """Bucket to chunks: for each context sent, the smallest doc_id of every window. What a chunk sent itself passes."""
    width, own = BEFORE + WINDOW + 2, pc.is_null(rows.column("bucket"))
    names, kinds = ["chunk", "bucket", "least", "places", "numbers"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    passed, rows = rows.filter(own).select(names), rows.filter(pc.invert(own))
    if not rows.num_rows:
        return passed
    sent = [np.frombuffer(zstandard.ZstdDecompressor().decompress(c.as_py()), np.uint8).reshape(-1, width) for c in rows.column("contexts")]
    contexts = np.concatenate(sent)
    ids = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in rows.column("least")])
    first, of = distinct_rows(contexts)
    least = np.full(len(first), NONE)
    np.minimum.at(least, of, ids)
    answer = least_by_offset(contexts[first], least)
    edges = np.r_[0, np.cumsum([len(s) for s in sent])]
    out = [(c, b, packed_least(answer[of[s:e]]), None, None) for c, b, s, e in zip(rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist(), edges, edges[1:], strict=False)]
    return pa.concat_tables([_table(out, names, kinds), passed])


def spans_of(starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and end of the maximal runs that windows at ascending starts cover."""
    if not len(starts):
        return doc, starts, starts
    new = np.r_[True, (starts[1:] > starts[:-1] + WINDOW) | (doc[1:] != doc[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]
    return doc[new], starts[new], starts[last] + WINDOW


def _cut(full: bool):
    """Chunk, its places and the answers to: a row per document."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs) if docs.num_rows else None
        starts = [np.zeros(0, np.int64)]
        if chunk and answers.num_rows:
            own = [r for r in answers.to_pylist()]
            state = next(r for r in own if r["bucket"] is None)
            place, number = np.frombuffer(state["places"], "<i8"), np.frombuffer(state["numbers"], "<i8")
            held = [unpacked_least(r["least"]) for r in sorted((r for r in own if r["bucket"] is not None), key=lambda r: r["bucket"])]
            least = np.concatenate(held) if held else np.zeros((0, REACH), np.int64)
            doc = np.searchsorted(chunk.bounds, place, side="right") - 1
            for o in range(REACH):
                starts.append(place[least[number, o] < chunk.ids[doc]] - o)
        at = np.unique(np.concatenate(starts))
        rows, left = [], []
        if chunk:
            doc, begin, end = spans_of(at, np.searchsorted(chunk.bounds, at, side="right") - 1)
            of = np.searchsorted(doc, np.arange(len(chunk.ids) + 1))
            for k, row in enumerate(chunk.order.tolist()):
                lo, hi = int(chunk.bounds[k]), int(chunk.bounds[k + 1])
                b, e = begin[of[k] : of[k + 1]], end[of[k] : of[k + 1]]
                kept = chunk.text[lo:hi] if not len(b) else b"".join(chunk.text[x:y] for x, y in zip([lo, *e.tolist()], [*b.tolist(), hi], strict=True))
                if full:
                    left.append((row, kept.decode("utf-8", "ignore")))
                else:
                    rows.append((docs.column("doc_id")[row].as_py(), hi - lo, hi - lo - len(kept), len(b), hashlib.sha256(kept).hexdigest(), ((b - lo).tolist(), (e - lo).tolist())))
        if full:
            left.sort()
            text = pa.array([t for _, t in left], pa.string())
            docs = docs.drop_columns(["chunk"])
            return docs.set_column(docs.column_names.index("text"), "text", text)
        flat = [(*r[:5], *r[5]) for r in rows]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return _table(flat, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"], kinds)

    return run


def _dealt(docs: DataFrame, chunks: int) -> DataFrame:
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce("text", F.lit("")), "chunk": number})


def _answered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents dealt to chunks, and by chunk what it needs to cut them.

    The documents are shuffled once: asking, cutting contexts and cutting text
    read the same exchange.
    """
    chunks = chunk_count(docs)
    dealt = _dealt(docs, chunks)
    by = dealt.groupBy("chunk")
    shared = by.applyInArrow(_ask(chunks), "bucket int, chunk int, keys binary, several binary").groupBy("bucket").applyInArrow(_shared, "chunk int, bucket int, mask binary")
    sent = by.cogroup(shared.groupBy("chunk")).applyInArrow(_contexts(chunks), "to int, bucket int, chunk int, contexts binary, least binary, places binary, numbers binary")
    told = sent.groupBy("to").applyInArrow(_sorted, "chunk int, bucket int, least binary, places binary, numbers binary")
    return dealt, told


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops of every document.

    starts and stops are the maximal runs of removed bytes in the text's UTF-8
    (null text: empty); every byte that a window of 50 bytes covers goes if
    the same window also starts in a document with a smaller doc_id. A null
    doc_id counts as larger than all others; rows that repeat a doc_id don't
    remove from each other. Other columns are ignored.
    """
    dealt, answers = _answered(docs.select("doc_id", "text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(False), schema)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without the bytes that repeated_spans removes; all columns kept.

    Bytes of characters that were cut through go too. Rows of which nothing
    is left are dropped, and n_chars, where there is such a column, is
    counted anew.
    """
    names = docs.columns
    # chunks are named "chunk" here, so a column of that name goes by another
    free = next(f"chunk_{i}" for i in range(len(names) + 1) if f"chunk_{i}" not in map(str.lower, names))
    docs = docs.toDF(*[free if n.lower() == "chunk" else n for n in names])
    dealt, answers = _answered(docs)
    kept = dealt.drop("chunk").schema
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(True), kept).where("text <> ''").toDF(*names)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint is the bitwise majority of the XXH64 values of its
word shingles. Anchors are the codewords of a perfect code on the lowest bits
of the fingerprint: the binary Golay code of length 23, covering radius 3, or
two copies of it on 46 bits when there are more fingerprints than one code
spreads well. Each fingerprint lies within the radius of exactly one anchor,
its home, and is replicated to every anchor within radius plus threshold. Of
two fingerprints at most the threshold apart, each one's home is then an
anchor of the other, so comparing guests with residents per anchor loses no
link. Equal fingerprints are one row before any of this, and each anchor gives
back a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.common import parts, saved
from certus.llm.components import connected_components, spanning_links

WORDS, SEED, THRESHOLD = 3, 42, 2
#: Length, covering radius and generator polynomial of the binary Golay code (fixed values).
LENGTH, RADIUS, GENERATOR = 23, 3, 0b110001110101
#: Fingerprints that one code's 4096 anchors may spread; beyond, two codes are used.
ONE_CODE = 1 << 21
#: Residents of an anchor that are compared at once; more are dealt to several groups.
RESIDENTS = 4096


def codewords() -> np.ndarray:
    """The 4096 codewords: multiples of the generator over GF(2)."""
    m = np.arange(1 << (LENGTH - 11), dtype=np.uint32)
    out = np.zeros_like(m)
    for bit in range(LENGTH - 11):
        out ^= np.where(m >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0))
    return out


def shingles(text: str | None, words: int = WORDS) -> list[bytes]:
    """Space-joined runs of words, repeats included; fewer words: the whole sequence."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    if len(w) <= words:
        return [joined]
    starts = list(accumulate(map((1).__add__, map(len, w)), initial=0))
    return [joined[a : b - 1] for a, b in zip(starts, starts[words:], strict=False)]


def majority(h: np.ndarray) -> int:
    """Bit j is set if bit j of more than half of the hashes is; none: 0."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 18):
        block = h[i : i + (1 << 18)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The majority of the shingles' hashes; no words: 0."""
    s = shingles(text, words)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64, len(s)))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row; null texts count as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(words), "doc_id long, fp long")


@cache
def _homes() -> tuple[np.ndarray, np.ndarray]:
    """The words within the radius of the zero codeword, and the anchor within the radius of every 23-bit word."""
    words, code = np.arange(1 << LENGTH, dtype=np.uint32), codewords()
    near = words[np.bitwise_count(words) <= RADIUS]
    home = np.zeros(1 << LENGTH, np.uint16)
    for shift in near:
        home[code ^ shift] = np.arange(len(code), dtype=np.uint16)
    return near, home


@cache
def _around(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word within the radius of the zero codeword: where its anchors within reach begin; anchors; distances."""
    d = np.bitwise_count(_homes()[0][:, None] ^ codewords()[None, :])
    r, a = np.nonzero(d <= reach)
    return np.searchsorted(r, np.arange(len(d) + 1)), a, d[r, a]


def anchors_of(low: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 23-bit word: row, anchor and distance of the anchors within reach.

    The code is linear and numbers its words linearly, so the anchors around a
    word are those around its offset from home, moved there.
    """
    low = low.astype(np.uint32)
    near, homes = _homes()
    home = homes[low]
    begin, anchor, far = _around(reach)
    at = np.searchsorted(near, low ^ codewords()[home])
    count = begin[at + 1] - begin[at]
    row = np.repeat(np.arange(len(low)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - begin[at], count)
    return row, anchor[place] ^ home[row].astype(np.int64), far[place].astype(np.int64)


def _covered(codes: int, threshold: int):
    """Replicates (doc_id, fp) to its anchors; home marks the one within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                doc, fp = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                mask = np.uint64((1 << LENGTH) - 1)
                row, anchor, d = anchors_of(fp & mask, RADIUS + threshold)
                extra = np.maximum(d - RADIUS, 0)
                if codes == 2:
                    row2, anchor2, d2 = anchors_of(fp >> np.uint64(LENGTH) & mask, RADIUS + threshold)
                    extra2 = np.maximum(d2 - RADIUS, 0)
                    first = np.searchsorted(row2, np.arange(len(fp)))
                    count = np.bincount(row2, minlength=len(fp))
                    left = np.repeat(np.arange(len(row)), count[row])
                    ends = np.cumsum(count[row])
                    right = np.arange(len(left)) - np.repeat(ends - count[row], count[row]) + np.repeat(first[row], count[row])
                    near = extra[left] + extra2[right] <= threshold
                    left, right = left[near], right[near]
                    row, anchor, extra = row[left], anchor[left] << 12 | anchor2[right], extra[left] + extra2[right]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(extra == 0), pa.array(doc[row]), pa.array(fp[row].view(np.int64))], names=["anchor", "home", "doc_id", "fp"])

    return run


def _compared(threshold: int):
    """One group holds many anchors; compares each anchor's guests with its residents."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["anchor", "part"], kind="stable")
        doc, fp, home = group["doc_id"].to_numpy(), group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy()
        key = group["anchor"].to_numpy() * 1_000_003 + group["part"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        a, b = [], []
        for s, e in zip(cuts, cuts[1:], strict=False):
            at = np.flatnonzero(home[s:e]) + s
            step = max(1, (1 << 22) // max(1, e - s))
            for i in range(0, len(at), step):
                near = np.bitwise_count(fp[at[i : i + step], None] ^ fp[None, s:e]) <= threshold
                x, y = np.nonzero(near)
                x, y = at[i + x], s + y
                apart = x != y
                a.append(x[apart])
                b.append(y[apart])
        if not a or not sum(map(len, a)):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        ids, node = np.unique(doc, return_inverse=True)
        root = spanning_links(len(ids), node[np.concatenate(a)], node[np.concatenate(b)])
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return run


def simhash_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links a, b that span the same components as all pairs within the threshold.

    ``distinct`` has one row (doc_id, fp) for each different fingerprint.
    """
    n = distinct.count()
    codes = 1 if n <= ONE_CODE else 2
    covered = distinct.select("doc_id", "fp").mapInArrow(_covered(codes, threshold), "anchor long, home boolean, doc_id long, fp long")
    crowded = covered.where("home").groupBy("anchor").count().where(F.col("count") > RESIDENTS).select("anchor", F.ceil(F.col("count") / RESIDENTS).cast("int").alias("n"))
    dealt = covered.join(crowded, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    # an anchor's residents are dealt to n parts, and its guests go to each of them
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("home", F.col("home") & (F.col("part") == F.col("own")))
    groups = max(64, 2 * parts(distinct.sparkSession), n // 20_000)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("anchor", "part"), F.lit(groups)).cast("int"))
    return dealt.select("bucket", "anchor", "part", "home", "doc_id", "fp").groupBy("bucket").applyInPandas(_compared(threshold), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    component_id is the smallest doc_id that links reach, the document's own
    included. A null text is an empty one; texts without words have fingerprint
    zero and link like any other. Rows that repeat a doc_id are returned as
    often as they occur. A row whose doc_id is null can't be named by a
    component: it links with nothing, and its component_id is null. Other
    columns are ignored. An empty table gives an empty result.
    """
    every = saved(fingerprints(docs, words))
    own = every.where("doc_id is not null")
    first = saved(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = connected_components(simhash_links(first, threshold))
    # a doc_id that occurs twice may have two fingerprints; they are one document
    twice = own.groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1").select("doc_id")
    both = own.join(twice, "doc_id").join(first.withColumnRenamed("doc_id", "b"), "fp").select(F.col("doc_id").alias("a"), "b")
    if not both.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(both))
    labelled = first.join(roots, first.doc_id == roots.node, "left").select("fp", F.coalesce("root", "doc_id").alias("component_id"))
    told = own.join(labelled, "fp").unionByName(every.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")), allowMissingColumns=True)
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that are the first of their component; all columns kept."""
    groups = simhash_groups(docs.select("doc_id", "text"), words, threshold)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)

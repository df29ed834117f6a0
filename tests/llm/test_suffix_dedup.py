"""Suffix order against sorting; removed bytes against all windows."""

import hashlib
import random

import numpy as np
import pytest

from certus.llm import common, suffix_dedup
from certus.llm.suffix_dedup import cut_repeats, repeated_spans
from certus.llm.suffixes import suffix_order

SCHEMA = "doc_id long, text string, lang string, starts int, n_chars long"


def test_suffix_order():
    r = random.Random(1)
    cases = [[r.randrange(r.choice([1, 2, 3, 10])) for _ in range(r.randrange(30))] for _ in range(4000)]
    for _ in range(200):
        u = [r.randrange(2) for _ in range(r.randrange(1, 6))]
        cases.append(u * r.randrange(1, 30) + [r.randrange(3) for _ in range(r.randrange(5))] + u * r.randrange(20))
    for s in cases:
        assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("together", [5, 4096])
def test_anchor_order_is_that_of_the_bytes(monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "SORTED", together)
    rng = np.random.default_rng(together)
    for n in (0, 1, 40, 300):
        cluster = rng.integers(0, max(1, n // 5), n)
        after = rng.integers(0, 3, (n, 50)).astype(np.uint8) * 100
        after[:, :24] = cluster[:, None]
        if n:
            after[rng.integers(0, n, n // 3), 24:] = after[0, 24:]
        got = suffix_dedup.anchor_order(after, cluster)
        keys = [(int(cluster[i]), after[i].tobytes()) for i in got]
        assert sorted(got.tolist()) == list(range(n)) and keys == sorted(keys)


def plain(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows():
    r = random.Random(9)
    words = ["a", "of", "thé", "löng", "tion", "xyzzy", "\n"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [make(14) for _ in range(5)] + ["b" * 60, "ab" * 40, make(9)]
    out = []
    for i in range(120):
        parts = [make(r.choice([0, 3, 30, 200])) for _ in range(r.randrange(4))]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        out.append((i * 3, "".join(parts)))
    for i in range(30):
        t = list(out[r.randrange(120)][1])
        if t and i % 2:
            t[r.randrange(len(t))] = "Q"
        out.append((1000 + i, "".join(t)))
    return [*out, (2000, None), (2001, ""), (2002, "x" * 49), (2003, "x" * 50), (2004, "x" * 51), (2005, "x" * 3000), (2006, "y" + "x" * 48)]


@pytest.mark.parametrize("size", [2000, 1 << 20])
def test_removed_bytes_match_all_windows(spark, monkeypatch, size):
    monkeypatch.setattr(common, "CHUNK_BYTES", size)
    got = repeated_spans(spark.createDataFrame([(*x, "en", 1, 2) for x in rows()], SCHEMA)).collect()
    assert sorted(tuple(x)[:5] for x in got) == plain(rows())
    texts = dict(rows())
    for x in got:
        data = (texts[x.doc_id] or "").encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *x.stops], [*x.starts, len(data)]))
        assert hashlib.sha256(kept).hexdigest() == x.kept_sha256


def test_repeated_rows_nulls_and_empty(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it"
    docs = spark.createDataFrame([(1, text, "en", 1, 0), (1, text, "en", 1, 0), (5, "é" + text + "é", None, None, 0), (None, text, "x", 1, 0), (None, text + "!", "x", 1, 0)], SCHEMA)
    got = sorted(((x.doc_id or 0, x.n_removed, x.n_spans) for x in repeated_spans(docs).collect()))
    n = len(text)
    assert got == [(0, n, 1), (0, n, 1), (1, 0, 0), (1, 0, 0), (5, n, 1)]
    assert sorted((x.doc_id or 0, x.text, x.n_chars) for x in cut_repeats(docs).collect()) == [(0, "!", 1), (1, text, n), (1, text, n), (5, "éé", 2)]
    assert cut_repeats(docs).columns == docs.columns
    assert repeated_spans(docs.limit(0)).count() == 0 and cut_repeats(docs.limit(0)).count() == 0
    assert repeated_spans(docs.select("doc_id", suffix_dedup.F.lit("").alias("text"))).count() == 5

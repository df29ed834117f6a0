"""SimHash groups against a comparison of all pairs."""

import random

import numpy as np
import xxhash

from certus.llm import simhash
from certus.llm.simhash import anchors_of, codewords, fingerprint, simhash_dedup, simhash_groups

SCHEMA = "doc_id long, text string, fp string, anchor int"


def plain_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_groups(rows):
    fp = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 2 and root[i] > root[j]:
                    root[i], changed = root[j], True
    return {(i, f"{fp[i]:016x}", root[i]) for i in fp}


def test_code_is_perfect():
    d = np.bitwise_count(np.arange(1 << 12, dtype=np.uint32)[:, None] * np.uint32(2039) % np.uint32(1 << 23) ^ codewords()[None])
    assert ((d <= 3).sum(1) == 1).all()


def rows_with_copies():
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows, base = [], []
    for i in range(60):
        base.append([r.choice(words) for _ in range(r.choice([1, 2, 3, 40, 400]))])
        rows.append((i, " ".join(base[-1])))
    for i in range(60, 110):
        b = list(r.choice(base))
        if len(b) > 100:
            b[r.randrange(len(b))] = r.choice(words)
        rows.append((i, "\t ".join(b).upper()))
    return [*rows, (200, ""), (201, None), (202, " \n"), (203, "É é x y z")]


def test_groups_match_all_pairs(spark):
    rows = rows_with_copies()
    got = simhash_groups(spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {tuple(x) for x in got} == plain_groups(rows)


def test_two_codes_and_dealt_residents_lose_nothing(spark, monkeypatch):
    rows = rows_with_copies()
    monkeypatch.setattr(simhash, "ONE_CODE", 0)
    monkeypatch.setattr(simhash, "RESIDENTS", 2)
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(x) for x in got} == plain_groups(rows)


def test_every_flip_of_two_bits_shares_an_anchor():
    r = random.Random(1)
    for _ in range(50):
        x = r.getrandbits(23)
        y = x ^ 1 << r.randrange(23) ^ 1 << r.randrange(23)
        row, anchor, _ = anchors_of(np.array([x, y]), 5)
        home, a, _ = anchors_of(np.array([x]), 3)
        assert len(home) == 1 and a[0] in set(anchor[row == 1])


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (None, "a b c d"), (9, "other words in here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_groups(docs).collect()
    assert sorted((x.doc_id or 0, x.component_id) for x in got) == [(0, None), (2, 2), (4, 2), (4, 2), (9, 9)]
    assert len({x.fingerprint for x in got}) == 2
    assert sorted(x.doc_id for x in simhash_dedup(docs).where("doc_id is not null").collect()) == [2, 9]
    assert simhash_groups(docs.limit(0)).count() == 0


def test_fingerprint_of_few_words():
    assert fingerprint(None) == fingerprint(" \t") == 0
    assert fingerprint("Ab  cD") == xxhash.xxh64_intdigest(b"ab cd", 42)

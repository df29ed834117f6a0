"""Near copies against a comparison of all pairs."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from certus.llm.near_copies import _paired, grams_of
from certus.llm.simhash import fingerprint


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def documents():
    r = random.Random(4)
    boiler = " ".join(f"b{r.randrange(900)}" for _ in range(40))
    texts = []
    for i in range(60):
        words = [f"w{r.randrange(4000)}" for _ in range(r.choice([30, 80, 400]))]
        texts.append(" ".join(words) + (" " + boiler if i % 3 == 0 else ""))
        for changes in range(1, 6):
            near = list(words)
            for _ in range(changes):
                near[r.randrange(len(near))] = f"n{r.randrange(4000)}"
            texts.append(" ".join(near) + (" " + boiler if i % 3 == 0 else ""))
    texts += [texts[7].upper(), texts[7], "one two", "one  two", "one two three", "", None]
    r.shuffle(texts)
    return [(i, t, "kept") for i, t in enumerate(texts)]


def test_all_pairs_at_four_fifths(spark):
    rows = documents()
    sets, root = [grams(t) for _, t, _ in rows], list(range(len(rows)))
    far = links = 0
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                links += 1
                far += (fingerprint(rows[i][1]) ^ fingerprint(rows[j][1])).bit_count() > 2
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert far > links / 2
    want = {i for i, x in enumerate(root) if i == x}
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "null id")], "doc_id long, text string, source string")
    got = corpus_pipeline.near_dedup(spark, docs.repartition(3), "").collect()
    assert {r.doc_id for r in got if r.doc_id is not None} == want and len(got) == len(want) + 1
    assert all((r.doc_id, r.text, r.source) in rows for r in got if r.doc_id is not None)


def test_repeated_id_and_empty_table(spark):
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(1, near, ""), (5, near + " more", ""), (5, "another text of its own here", ""), (7, "Another text of its own here", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_hashes_tell_shingles_apart():
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "ab", "ba", "é", "ß x", "y" * 255, "y" * 256, "y" * 300, "y" * 301]) for _ in range(n)) for n in (1, 2, 4, 5, 6, 50, 300) for _ in range(20)]
    texts += ["", None, " \t\n", "A  b\tC\nd e\r\x0bf\x0c", "a b c d e f", "x" * 70_000 + " tail of a very long word here"]
    seen = {}
    for t in texts:
        w = (t or "").encode().lower().split()
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        got = grams_of(t).tolist()
        assert len(got) == len(want) and got == sorted(set(got))
        for shingle in want:
            one = grams_of(b" ".join(shingle).decode()).tolist()
            assert one[0] in got and len(one) == 1
            assert seen.setdefault(one[0], shingle) == shingle
    assert grams_of(texts[-2]).tolist() == grams_of(texts[-3]).tolist()


def paired(few, gram, label, node):
    n, place = np.full(len(node), 200, np.int32), np.arange(len(node), dtype=np.int32) % 20
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (gram, label, node, n, place)], names=["gram", "label", "node", "n", "place"])
    out = pa.Table.from_batches(list(_paired(few)(iter([batch.slice(i, 7) for i in range(0, len(node), 7)]))))
    pairs = out.filter(pc.is_valid(out.column("b")))
    left = out.filter(pc.is_null(out.column("b")))
    return set(zip(pairs.column("node").to_pylist(), pairs.column("b").to_pylist(), strict=True)), left


def test_pairs_of_a_crowd_grow_with_its_size():
    node = np.arange(1000)
    gram, label = np.where(node < 990, 1, 2), np.where(node < 300, 0, node)
    every, left = paired(None, gram, label, node)
    alone = set(combinations(range(990, 1000), 2))
    assert len(every) == 990 * 989 // 2 - 300 * 299 // 2 + len(alone) and not left.num_rows
    few, left = paired(8, gram, label, node)
    assert few < every and len(few) <= 2 * 8 * 1000
    assert sorted(left.column("node").to_pylist()) == list(range(1000))
    assert {n for p in few for n in p} == set(range(1000))
    small, left = paired(16, gram[990:], label[990:], node[990:])
    assert small == alone and not left.num_rows

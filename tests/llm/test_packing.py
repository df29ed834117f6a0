"""Minimum bin slack against brute force, and whole packings."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from certus.llm.packing import ByteLevel, bin_plan, cuts, default_tokenizer, fullest, pack

ODD = ["", None, " ", "a", "a  b", "a \n b\n\n  c", "it's  we'll x \x1c y", "漢字 かな é\tb ", "<|endoftext|> x", "tail  ", "\n", "x.\nY, z!?  'S", "\x85 q 　 r"]


def test_fullest_matches_brute_force():
    r = random.Random(2)
    for _ in range(300):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(6))}
        room = r.randrange(0, 60)
        taken = fullest(counts, room)
        assert all(n <= counts[x] for x, n in taken.items())
        items = list(counts.items())
        best = max(s for pick in itertools.product(*[range(n + 1) for _, n in items]) if (s := sum(k * x for k, (x, _) in zip(pick, items))) <= room)
        assert sum(x * n for x, n in taken.items()) == best


def test_plan_uses_every_piece_once():
    r = random.Random(4)
    counts = {x: r.randrange(1, 300) for x in r.sample(range(1, 1025), 400)}
    plan = bin_plan(counts)
    used = {}
    for taken, times in plan:
        assert 0 < sum(x * n for x, n in taken.items()) <= 1024
        for x, n in taken.items():
            used[x] = used.get(x, 0) + n * times
    assert used == counts
    least = -(-sum(x * n for x, n in counts.items()) // 1024)
    assert least <= sum(t for _, t in plan) <= max(least + 3, max(1.02 * least, sum(n for x, n in counts.items() if x > 512)))


def test_ids_match_the_library():
    library = Tokenizer.from_file(default_tokenizer())
    mine, r = ByteLevel(default_tokenizer()), random.Random(7)
    special = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\ny", " <|endoftext|>", "<|endoftext", "<|endof text|>"]
    texts = [t or "" for t in ODD] + special + ["".join(r.choice(" \n\tab.,'s9é　 漢\x1c 🙂") for _ in range(r.randrange(16))) for _ in range(4000)]
    many = mine.encode(texts)
    assert many == [mine.encode([t])[0] for t in texts]
    for text in texts:
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("capacity", [8, 1024])
def test_pack(spark, capacity):
    r = random.Random(1)
    texts = ODD + ["one <|endoftext|> two"] + [" ".join(r.choice(["the", "of", "Zug", "été"]) for _ in range(r.choice([1, 3, 10, 1500]))) for _ in range(60)]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3), capacity=capacity).collect()
    library = Tokenizer.from_file(default_tokenizer())
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by[i], key=lambda x: x.piece)
        assert [(x.start, x.length) for x in own] == cuts(len(ids), capacity)
        assert all(x.length == capacity for x in own[1:])
        assert [x.ids_crc32 for x in own] == [zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) for x in own]
    bins = {}
    for x in got:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity


def test_repeated_rows_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = pack(docs).collect()
    assert sorted((x.doc_id or 0, x.length) for x in got) == [(0, 1), (1, 3), (1, 3)]
    assert len({x.sequence_id for x in got}) == 1
    assert pack(docs.limit(0)).count() == 0


def test_latin_words_need_no_library_call(monkeypatch):
    model = ByteLevel(default_tokenizer())
    texts = ["Plain words, wörds\nand (no) more; ſt ǀa.", *("\n".join(f"{chr(i)}{a} {a}{chr(i)}" for i in range(0x20, 0x260)) for a in ("", ".", "'", "x", "-"))]
    want = [np.array(x.ids, "<u4").tobytes() for x in model.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert model.encode(texts) == want
    sent, own = [], model._words
    monkeypatch.setattr(model, "_words", lambda words: sent.extend(words) or own(words))
    model.encode(["Never before seen: wörds; naturally. Ĝis la revido!"])
    assert sent == []

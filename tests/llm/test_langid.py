"""The string kernel against its definition, and held-out accuracy."""

import random
import zlib

import numpy as np

from certus.llm import langid
from certus.llm.langid import GRAMS, KernelClassifier, keep_identified, predict_language, present

SYLLABLES = {"aa": ["ka", "ki", "lo", "mu", "ran"], "bb": ["sch", "ung", "ein", "lo", "mu"], "cc": ["é", "que", "lo", "ran", "ou"]}


def text_in(lang, r, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def plain_grams(text):
    """Codes of the different n-grams, one at a time."""
    s, before = [0], False
    for c in text:
        v = (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
        if v or before:
            s.append(v)
        before = v > 0
    s.append(0)
    out = set()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = n
            for v, k in zip(s[i : i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                h = (h ^ v) * k % (1 << 32)
                h ^= h >> 15
            out.add(h % GRAMS)
    return out


def test_presence_matches_sets():
    r = random.Random(1)
    texts = [text_in(x, r, 30) for x in SYLLABLES] + ["", "1", "a", "Ab 12 --cd", "É\n\nx", "Привіт, світе", "漢字かな", "𐐀𐐁 mixed 🙂", "İ"]
    flags = np.zeros(GRAMS, bool)
    for t in texts:
        assert set(present(t, flags).tolist()) == plain_grams(t)
        assert not flags.any()


SCRIPTS = {"ru": "это был ещё один день когда мы вышли из дома и пошли туда где всё начиналось", "uk": "це був ще один день коли ми вийшли з дому і пішли туди де все починалося її їх", "zh": "这是我们离开家的那一天我们走到一切开始的地方", "ja": "これは私たちが家を出てすべてが始まった場所へ歩いた日です", "el": "αυτή ήταν μια ακόμη μέρα που φύγαμε από το σπίτι"}


def test_predictions_against_a_dense_evaluation(spark):
    """Labelled languages of many scripts; each prediction is the kernel's sum over landmarks, text by text, with the same weights."""
    r = random.Random(5)
    make = lambda lang: "".join(r.choice(SCRIPTS[lang]) for _ in range(12)) if lang in ("zh", "ja") else " ".join(r.choice(SCRIPTS[lang].split()) for _ in range(8))
    rows = [(i, make(lang), lang) for i, lang in enumerate(r.choice(list(SCRIPTS)) for _ in range(500))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in predict_language(docs).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    model = langid._fitted(docs)
    marks = [set(np.flatnonzero(model.column >= 0)[m > 0].tolist()) for m in model.marks]
    for i, text, _ in rows[:150]:
        own = plain_grams(text)
        kernel = [len(own & m) / (len(own) * len(m)) ** 0.5 for m in marks]
        f = np.array(kernel) @ model.weights.astype(float) + model.bias
        p = np.exp(4 * (f - f.max()))
        assert got[i].lang_pred == model.langs[int(f.argmax())] and abs(got[i].score - (p / p.sum()).max()) < 1e-3


def test_kernel_matches_definition():
    r = random.Random(2)
    langs = [x for x in SYLLABLES for _ in range(20)]
    texts = [text_in(x, r, 25) for x in langs]
    model, flags = KernelClassifier(texts, langs, 6), np.zeros(GRAMS, bool)
    sets = [set(present(t, flags).tolist()) for t in texts]
    got = model._kernel([np.array(sorted(s)) for s in sets])
    marks = [set(np.flatnonzero(model.column >= 0)[row > 0].tolist()) for row in model.marks]
    want = [[len(s & m) / (len(s) * len(m)) ** 0.5 for m in marks] for s in sets]
    assert np.allclose(got, want, atol=1e-5)


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(3)
    rows = [(i, text_in(x, r, r.choice([2, 20, 200])), x) for i, x in enumerate(r.choice(list(SYLLABLES)) for _ in range(400))]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 -- !", "cc"), (903, "x", None), (904, "é" * 100_000, "cc"), (None, "ka ki", "aa")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows + odd], "doc_id long, text string, lang string, score double")
    got = {x.doc_id: x for x in predict_language(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i].lang_pred, x) for i, _, x in rows if got[i].held_out]
    assert len(held) > 60 and np.mean([a == b for a, b in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred in SYLLABLES and got[904].lang_pred == "cc"
    assert all(0 <= x.score <= 1 for x in got.values())
    kept = {x.doc_id for x in keep_identified(docs).collect()}
    assert {i for i, _, _ in rows} <= kept and not kept & {900, 901, 902}
    assert predict_language(docs.limit(0)).count() == 0
    assert {x.lang_pred for x in predict_language(docs.where("lang is null")).collect()} == {"und"}

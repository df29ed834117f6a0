"""The recurrent model: gradients, carried state, probabilities; counts against plain ones."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from certus.llm import common, lm_score
from certus.llm.gru import GRU
from certus.llm.lm_score import RARE, Scorer, Spelling, fitted, rare_class, score_documents, words_of

SCHEMA = "doc_id long, text string, score string"


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = GRU(np.array([9.0] * 40 + [30.0]))
    for k, w in model.p.items():
        if k != "word_b":
            model.p[k] = rng.normal(0, 0.3, w.shape).astype(np.float64)
    model.p["word_b"] = np.where(model.p["word_b"] < -100, -1e4, rng.normal(0, 0.3, model.p["word_b"].shape))
    x, y = rng.integers(0, 41, (6, 5)), rng.integers(0, 41, (6, 5))
    keep = (rng.random((6, 5)) > 0.2).astype(float)
    h = rng.normal(size=(5, 32))

    def loss():
        _, out = model._window(x, keep, h)
        return -model._word_logs(out.reshape(-1, 32), y.ravel()).mean()

    grads, _ = model._gradients(x, y, keep, h)
    for k, g in grads.items():
        flat = model.p[k].reshape(-1)
        for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-2 - g.reshape(-1)[at]) < 2e-4, k


def test_score_carries_state_and_sums_to_one():
    rng = np.random.default_rng(2)
    model = GRU(np.array([5.0] * 40 + [20.0]))
    model.train([rng.integers(0, 41, 3000)], 0, passes=20)
    docs = [rng.integers(0, 41, n) for n in (1, 300, 7, 65, 2, 64)]
    got = model.score(docs, 0, slots=3)
    for d, s in zip(docs, got):
        steps, out = model._window(np.r_[0, d[:-1]][:, None], np.r_[0, np.ones(len(d) - 1)][:, None], np.zeros((1, 32)))
        assert abs(model._word_logs(out[:, 0], d).sum() - s) < 1e-2
    h = np.repeat(out[-1], 41, 0)
    assert abs(np.exp(model._word_logs(h, np.arange(41))).sum() - 1) < 1e-4


def test_spelling_is_a_distribution():
    words = [b"ab", b"abab", b"b", b"ba"]
    text = b"   " + b"   ".join(words) + b" "
    runs = Counter(text[i : i + 4] for i in range(len(text) - 3) if text[i + 2 : i + 4] != b"  ")
    spelling = Spelling(np.array([int.from_bytes(r, "big") for r in runs]), np.array(list(runs.values())))
    assert all(abs(spelling.of((c << 8) + np.arange(256)).sum() - 1) < 1e-9 for c in (0x202020, 0x202061, 0x616261, 0x7A7A7A))
    for w in [*words, b"abba", b"q"]:
        t = b"   " + w + b" "
        want = sum(math.log(spelling.of(np.array([int.from_bytes(t[i : i + 4], "big")]))[0]) for i in range(len(t) - 3))
        assert math.isclose(spelling.logs([b"zz", w, b"a"])[1], want, rel_tol=1e-9)
    mass = spelling.class_mass()
    assert abs(mass.sum() - 1) < 1e-6
    scorer = Scorer(100, 3, 1, [(b"", 50)], np.full(RARE, 2.0), spelling)
    got = scorer.rare_logs([b"abba"], np.array([3]))[0]
    want = scorer.unseen * math.exp(spelling.logs([b"abba"])[0]) / mass[rare_class(b"abba")] + (1 - scorer.unseen) * 3 / scorer.rare[rare_class(b"abba")]
    assert math.isclose(got, math.log(want), rel_tol=1e-9)


def rows():
    r = random.Random(3)
    order = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["ran", "sat"], "sat": ["the", "on"], "ran": ["the", "on"], "on": ["the"]}
    out = []
    for i in range(500):
        w = ["the"]
        for _ in range(r.choice([3, 30, 200])):
            w.append(f"Rare{r.randrange(9000)}" if r.random() < 0.02 else r.choice(order.get(w[-1], ["the"])))
        out.append((i, " \t".join(w)))
    return [*out, (600, None), (601, ""), (602, "unseen wörds only " * 3000), (None, "the cat"), (3, out[3][1])]


@pytest.mark.parametrize("size", [40_000, 12 << 20])
def test_counts_and_gain(spark, monkeypatch, size):
    monkeypatch.setattr(common, "CHUNK_BYTES", size)
    got = score_documents(spark.createDataFrame([(*x, "clash") for x in rows()], SCHEMA)).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter()
    for i, t in rows():
        if not held(i):
            count.update(words_of((t or "").encode()))
    n, v, texts = sum(count.values()), len(count), {i: t or "" for i, t in rows()}
    assert len(got) == len(rows())
    for x in got:
        w = words_of(texts[x.doc_id].encode())
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(x.doc_id), len(w), sum(count[t] > 0 for t in w), n)
        assert math.isclose(x.base_score, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), rel_tol=1e-9)
        assert math.isfinite(x.score) and x.score < 0
    test = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 500]
    assert sum(x.score for x in test) > 0.7 * sum(x.base_score for x in test)


def test_scores_against_a_plain_loop(spark, monkeypatch):
    """One document and one word at a time, with the same weights: gates, both softmaxes, rare words."""
    monkeypatch.setattr(common, "CHUNK_BYTES", 60_000)
    docs = spark.createDataFrame([(*x, "clash") for x in rows() if x[0] is None or x[0] % 7 == 0 or x[0] > 500], SCHEMA)
    scorer, _, _, _ = fitted(docs.select("doc_id", "text"))
    p, sigmoid = {k: w.astype(np.float64) for k, w in scorer.model.p.items()}, lambda z: 1 / (1 + np.exp(-z))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter()
    for r in docs.collect():
        if not held(r.doc_id):
            count.update(words_of((r.text or "").encode()))
    softmax = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())

    def plain(text):
        h, before, total = np.zeros(32), scorer.words[b""], 0.0
        for w in words_of(text.encode()):
            gates, s = p["embed"][before] @ p["input"] + p["bias"], h @ p["state"]
            z, r = sigmoid(gates[:32] + s[:32]), sigmoid(gates[32:64] + s[32:64])
            h = z * h + (1 - z) * np.tanh(gates[64:] + r * s[64:])
            before = scorer.words.get(w, len(scorer.words) + rare_class(w))
            c = before // 32 if w in scorer.words else scorer.model.classes + rare_class(w)
            total += softmax(h @ p["class_w"] + p["class_b"])[c]
            if w in scorer.words:
                total += softmax(p["word_w"][c] @ h + p["word_b"][c])[before % 32]
            else:
                spelled = scorer.unseen * math.exp(scorer.spelling.logs([w])[0]) / scorer.mass[rare_class(w)]
                total += math.log(spelled + (1 - scorer.unseen) * count[w] / max(1, scorer.rare[rare_class(w)]))
        return total / math.log(10)

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = score_documents(docs).collect()
    assert len(got) == docs.count()
    for x in got:
        if len(texts[x.doc_id]) < 5000:
            assert math.isclose(x.score, plain(texts[x.doc_id]), rel_tol=2e-3, abs_tol=1e-3)


def test_every_chunk_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 1 << 18)
    monkeypatch.setattr(lm_score, "TUNED_OF", 1)
    base = spark.createDataFrame([(i, f"w{i % 50} common words go here " * 600) for i in range(60)], "doc_id long, text string")
    assert sum(len(t) for t in lm_score.sample(base, 1 << 16)) < (1 << 16)
    long = spark.createDataFrame([(1, "long text of many words " * 60_000)], "doc_id long, text string")
    assert lm_score.sample(long, 1 << 18) and all(len(w) < 10_000 for w in lm_score.sample(long, 1 << 18))
    scorer, dealt, _, chunks = fitted(base)
    assert chunks >= 4
    before = scorer.model.packed()
    lm_score.tune(scorer, dealt, chunks)
    assert scorer.model.packed() != before and np.isfinite(np.frombuffer(scorer.model.packed(), "<f4")).all()


@pytest.mark.parametrize("size", [40_000, 12 << 20])
def test_every_training_word_is_learned_from(spark, monkeypatch, size):
    """Weights come from all training documents, down to the last words of a chunk."""
    monkeypatch.setattr(common, "CHUNK_BYTES", size)
    scorer, dealt, _, chunks = fitted(spark.createDataFrame(rows(), "doc_id long, text string"))
    assert lm_score.tune(scorer, dealt, chunks) == scorer.tokens > 20_000


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    only = score_documents(spark.createDataFrame([(0, None, "")], SCHEMA)).collect()
    assert len(only) == 1 and math.isfinite(only[0].score)

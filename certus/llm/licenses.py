"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A text is looked at by lines and by paragraphs, that is, the lines between
blank ones; longer ones than a window in overlapping windows. A window is a
sparse vector of hashed word one-, two- and three-grams. Multinomial logistic
regression, trained on variants of licence texts and on a bounded sample of
corpus lines, gives it a licence family or the class ``unknown``, whose
calibration is measured on variants kept aside. Every window of every text is
classified; where the unknown class is the most probable one, that is the
result. Elsewhere the windows that touch are one place, and a family counts if
a template of that family, compared word by word, is found there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.license_texts import BODIES, NOTICES
from certus.llm.wordcache import together

UNKNOWN = "unknown"
#: Share of a template's word pairs that a place must have.
CONFIRMED = 0.8
#: Words of a window, and from one to the next.
WINDOW, STEP = 16, 8
#: Hashed features; corpus lines for the unknown class, and the documents that are read for it.
FEATURES, NEGATIVES, SAMPLE_DOCUMENTS, SAMPLE_CHARS, STEPS = 1 << 16, 3000, 400, 100_000, 500
#: What the weights of a window's features are multiplied with.
SCALE = 0.2
#: Words whose hashes are remembered.
REMEMBERED = 1 << 20
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
BLANK = re.compile(r"\n[^\S\n]*(?=\n)")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pairs(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w, w[1:], strict=False))


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, set]]:
    """Family and word pairs of every notice and every paragraph of a licence."""
    return [(name, pairs(words(t))) for own in (NOTICES, BODIES) for name, texts in own.items() for t in texts]


def shares(w: list[str]) -> dict[str, tuple[float, int, set]]:
    """By family, of the template that is held best: the share of its pairs, their number and the pairs."""
    own, best = pairs(w), {}
    for name, p in templates():
        if p & own:
            best[name] = max(best.get(name, (0, 0, set())), (len(p & own) / len(p), len(p), p), key=lambda x: x[:2])
    return best


class Hasher:
    """Features of the n-grams that begin at each word."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, w: list[str]) -> np.ndarray:
        """Rows of three features: of one, two and three words; n-grams over the end have the feature 0."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        known.update((x, zlib.crc32(x.encode("utf-8", "surrogatepass"))) for x in set(w) - known.keys())
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        out = np.zeros((len(w), 3), np.int64)
        mixed = h
        for n in range(3):
            if n:
                mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n:]
            key = (mixed + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            out[: len(mixed), n] = 1 + (key >> np.uint64(40)) % np.uint64(FEATURES - 1)
        return out


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, start in it and end of the overlapping windows of units with so many words."""
    count = np.where(lengths > WINDOW, -(-(lengths - WINDOW) // STEP) + 1, lengths > 0)
    unit = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return unit, start, np.minimum(start + WINDOW, lengths[unit])


class Classifier:
    """Sparse logistic regression over licence families and the unknown class."""

    def __init__(self, lines: list[str], seed: int = 3):
        rng, hasher = np.random.default_rng(seed), Hasher()
        self.families = [*sorted(NOTICES), UNKNOWN]
        none = len(self.families) - 1
        filler = [x for p in lines for x in words(p)] or ["text"]
        rows: list[tuple[list[str], int]] = []
        for k, name in enumerate(self.families[:-1]):
            for text in NOTICES[name] + BODIES.get(name, []):
                w = words(text)
                for _ in range(24):
                    at = int(rng.integers(0, max(1, len(w) - WINDOW + 1)))
                    own = [x for x in w[at : at + WINDOW] if rng.random() > 0.04]
                    around = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, max(1, WINDOW - len(own) + 1)))]
                    cut = int(rng.integers(0, len(around) + 1))
                    rows.append(([*around[:cut], *own, *around[cut:]], k))
                    loose = [own[i] for i in rng.permutation(len(own))[: max(1, len(own) // 2)]]
                    rows.append(([*around[:cut], *loose, *around[cut:]], none))
        rows += [(w[:WINDOW], none) for w in map(words, lines) if w]
        features, want = [hasher(w).ravel() for w, _ in rows], np.array([k for _, k in rows])
        order = rng.permutation(len(rows))
        held, train = order[: len(order) // 5], order[len(order) // 5 :]
        self.weights, self.bias = np.zeros((FEATURES, len(self.families)), np.float32), np.zeros(len(self.families), np.float32)
        squares = np.full_like(self.weights, 1e-8)
        for _ in range(STEPS):
            batch = rng.choice(train, min(256, len(train)))
            d = self._softmax(np.array([self._logits(features[i]) for i in batch]))
            d[np.arange(len(batch)), want[batch]] -= 1
            self.bias -= 0.1 * d.mean(0)
            of = np.repeat(np.arange(len(batch)), [len(features[i]) for i in batch])
            flat = np.concatenate([features[i] for i in batch])
            order = np.argsort(flat, kind="stable")
            at, first = np.unique(flat[order], return_index=True)
            g = np.add.reduceat((SCALE * d)[of[order]], first).astype(np.float32)
            squares[at] += g * g
            self.weights[at] -= 0.5 * g / np.sqrt(squares[at]) + 1e-4 * self.weights[at]
        self.weights[0] = 0
        # the temperature, and what a family must reach, from what was kept aside
        z = np.array([self._logits(features[i]) for i in held])
        losses = {t: -np.log(self._softmax(z / t)[np.arange(len(held)), want[held]] + 1e-12).mean() for t in (0.25, 0.5, 1.0, 2.0, 4.0)}
        self.temperature = min(losses, key=losses.get)
        p = self._softmax(z / self.temperature)
        right = p[np.arange(len(held)), want[held]][(want[held] < none) & (p.argmax(1) == want[held])]
        #: Families with less are no candidates: 99 of 100 right ones kept aside have more.
        self.least = float(min(0.5, np.quantile(right, 0.01))) if len(right) else 0.5

    def _logits(self, features: np.ndarray) -> np.ndarray:
        return SCALE * self.weights[features].sum(0) + self.bias

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, features: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the families in windows of words, given each word's features."""
        if not len(start):
            return np.zeros((0, len(self.families)), np.float32)
        each = self.weights[features[:, 0]]
        each += self.weights[features[:, 1]]
        each += self.weights[features[:, 2]]
        total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, 0, np.float64)])
        z = SCALE * (total[end] - total[start]) + self.bias
        return self._softmax(z / self.temperature)

    def candidates(self, p: np.ndarray) -> list[str]:
        """Families that reach the calibrated threshold in some window, most probable first."""
        best = p[:, :-1].max(0)
        return [self.families[k] for k in np.argsort(-best, kind="stable") if best[k] >= self.least]


def places(model: Classifier, features: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
    """Unit, first and last word (with a step more on either side) and candidates of windows that touch and aren't unknown."""
    unit, start, end = windows(lengths)
    p = model.probabilities(features, starts[unit] + start, starts[unit] + end)
    at = np.flatnonzero(p.argmax(1) < len(model.families) - 1)
    new = np.r_[True, (unit[at][1:] != unit[at][:-1]) | (start[at][1:] > end[at][:-1])] if len(at) else np.zeros(0, bool)
    cuts = np.r_[np.flatnonzero(new), len(at)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        own, u = at[a:b], int(unit[at[a]])
        yield u, max(0, int(start[own].min()) - STEP), min(int(lengths[u]), int(end[own].max()) + STEP), model.candidates(p[own])


def confirmed(w: list[str], families: list[str]) -> tuple[str, int, int] | None:
    """The first of some families of which the words hold a template closely, and no other family's better; with its extent.

    The best share decides; of equal shares the longer template, so that GPL
    version 3 isn't taken for one without a version. What two families' texts
    have in common, and no more, is neither's.
    """
    best = shares(w)
    top = max((x[:2] for x in best.values()), default=(0, 0))
    if sum(x[:2] == top for x in best.values()) > 1:
        return None
    for name in families:
        share, n, held = best.get(name, (0, 0, set()))
        if share >= CONFIRMED and (share, n) == top:
            at = [i for i, pair in enumerate(zip(w, w[1:], strict=False)) if pair in held]
            return name, at[0], at[-1] + 1
    return None


def notices_in(model: Classifier, hasher: Hasher, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Family, first and last word of the notices in each text.

    A notice is found in a line, or in a paragraph of several lines where no
    line of its own has a notice of that family.
    """
    all_words: list[str] = []
    lines: list[tuple[int, int, int]] = []  # text, first word, number of words
    paragraphs: list[tuple[int, int, int]] = []
    for k, text in enumerate(texts):
        for paragraph in BLANK.split(text):
            first, n = len(all_words), 0
            for line in paragraph.split("\n"):
                if w := words(line):
                    lines.append((k, len(all_words), len(w)))
                    all_words += w
                    n += 1
            if n > 1:
                paragraphs.append((k, first, len(all_words) - first))
    features, out = hasher(all_words), [[] for _ in texts]
    for units in (lines, paragraphs):
        if units:
            of, starts, lengths = np.array(units).T
            for u, a, b, families in places(model, features, starts, lengths):
                at = int(starts[u])
                hit = confirmed(all_words[at + a : at + b], families)
                if hit:
                    own, found = (at + a + hit[1], at + a + hit[2]), out[int(of[u])]
                    if not any(name == hit[0] and s <= own[1] and own[0] <= e for name, s, e in found):
                        found.append((hit[0], *own))
    return out


def _scanned(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = [x for some in together([t or "" for t in b.column(1).to_pylist()]) for x in notices_in(model, hasher, some)]
                names = [",".join(sorted({name for name, _, _ in f})) for f in found]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["doc_id", "families", "n_notices"])

    return run


def sample(docs: DataFrame) -> list[str]:
    """Lines of a bounded number of documents, none of which holds half a template."""
    usable = docs.where((F.octet_length("text") > 0) & (F.octet_length("text") < SAMPLE_CHARS))
    rows = usable.select("text").orderBy(F.xxhash64("doc_id", "text", F.lit("licence")), "doc_id", "text").limit(SAMPLE_DOCUMENTS).collect()
    out = []
    for p in (p for r in rows for p in r.text.split("\n") if p.strip()):
        if len(out) == NEGATIVES:
            break
        if w := words(p)[: 2 * WINDOW]:
            if max((x[0] for x in shares(w).values()), default=0) < 0.5:
                out.append(" ".join(w))
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, families (sorted, comma-separated; empty: none), n_notices (places with a confirmed notice).

    Whole texts are read. A null text has no notice. Repeated rows and null
    ids each get a row; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scanned(Classifier(sample(docs))), "doc_id long, families string, n_notices long")

"""Language identification with a string kernel.

Two texts are as alike as the sets of character n-grams (lengths 1 to 3,
blended, hashed from their code points) that are present in both: the number
of shared n-grams over the root of the product of the set sizes. Landmark texts span a Nyström feature space
of this kernel, and one ridge regression per language against the rest is
solved in it. A batch of texts is scored by two matrix products: presence by
landmarks, then kernel values by the solved weights.

Letters of all scripts count, in lower case; what isn't a letter is one mark
for each run of it.

The model is fitted on a bounded sample of labelled rows: ``per_language``
texts of each language (chosen by a hash of doc_id), ``TRAIN_ROWS`` in all.
Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the fitted sample, and the number of landmarks in it.
PER_LANGUAGE, TRAIN_ROWS, LANDMARKS = 500, 4000, 128
#: Codes that n-grams are hashed to; regularisation; how scores are sharpened to shares.
GRAMS, RIDGE, SHARPNESS = 1 << 18, 1e-3, 4.0
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to that of the lower-case letter; 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            table[p] = ord(low) if len(low) == 1 else p
    return table


def symbols(text: str) -> np.ndarray:
    """Letters, and a 0 for each run of other characters and for both ends."""
    s = letters()[code_points(text)]
    return np.concatenate([np.zeros(1, np.uint32), s[(s > 0) | np.r_[False, s[:-1] > 0]], np.zeros(1, np.uint32)])


def codes(s: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of some symbols, of one after those of two after those of three."""
    out = []
    for n in (3, 2, 1):
        h = np.full(max(0, len(s) - n + 1), n, np.uint32)
        for k in range(n):
            h = (h ^ s[k : len(s) - n + 1 + k]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(GRAMS - 1))
    return np.concatenate(out)


def present(text: str, flags: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that occur, ascending. flags: zeros, left as such."""
    flags[codes(symbols(text))] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


class KernelClassifier:
    """Nyström landmarks and the solved weights of every language."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS):
        self.langs = sorted(set(langs))
        flags = np.zeros(GRAMS, bool)
        sets = [present(t, flags) for t in texts]
        chosen = self._landmarks(sets, langs, landmarks)
        grams = np.unique(np.concatenate([sets[i] for i in chosen]))
        self.column = np.full(GRAMS, -1, np.int32)
        self.column[grams] = np.arange(len(grams))
        self.marks = np.zeros((len(chosen), len(grams)), np.float32)
        for row, i in enumerate(chosen):
            self.marks[row, self.column[sets[i]]] = 1
        self.marks /= np.sqrt([len(sets[i]) for i in chosen])[:, None].astype(np.float32)
        kernel = np.vstack([self._kernel(sets[i : i + 256]) for i in range(0, len(sets), 256)]).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[chosen])
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = np.hstack([kernel @ root, np.ones((len(sets), 1))])
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        gram = features.T @ features + RIDGE * len(sets) * np.diag([*np.ones(features.shape[1] - 1), 0])
        solved = np.linalg.lstsq(gram, features.T @ target, rcond=None)[0]
        self.weights = (root @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    @staticmethod
    def _landmarks(sets: list[np.ndarray], langs: list[str], n: int) -> list[int]:
        """Of each language in turn, the texts with most n-grams among every other one."""
        by: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by.setdefault(lang, []).append(i)
        share = max(1, n // len(by))
        return sorted(i for own in by.values() for i in sorted(own[: 2 * share], key=lambda i: -len(sets[i]))[:share])

    def _kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), self.marks.shape[1]), np.float32)
        for row, s in enumerate(sets):
            c = self.column[s]
            x[row, c[c >= 0]] = 1 / np.sqrt(max(1, len(s)))
        return x @ self.marks.T

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score from 0 to 1 for each text."""
        flags = np.zeros(GRAMS, bool)
        f = self._kernel([present(t, flags) for t in texts]) @ self.weights + self.bias
        p = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        return f.argmax(1), p.max(1).astype(np.float64)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of the fitted sample, ordered by a hash of doc_id."""
    usable = docs.where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    each = min(per_language, max(1, TRAIN_ROWS // max(1, len(counts))))
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))]) if counts else None
    if chance is None:
        return [], []
    spot = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = usable.where(spot < chance[F.col("lang")]).select("text", "lang", spot.alias("spot")).orderBy("spot", "lang", "text").limit(2 * TRAIN_ROWS).collect()
    rows = [r for r in rows if any(map(str.isalpha, r.text))]
    return [r.text for r in rows], [r.lang for r in rows]


def _scored(model: KernelClassifier | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
    for at in range(0, len(known), 256):
        rows = known[at : at + 256]
        best, p = model.predict([texts[i] for i in rows])
        for i, k, s in zip(rows, best, p, strict=True):
            lang[i], score[i] = model.langs[k], float(s)
    return lang, score


def _predicted(model: KernelClassifier | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = _scored(model, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _identified(model: KernelClassifier | None, text: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = _scored(model, b.column(text).to_pylist())
            yield b.filter(pa.array([k != "und" and s >= least for k, s in zip(lang, score, strict=True)], pa.bool_()))

    return run


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def _fitted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> KernelClassifier | None:
    texts, langs = sample(docs.where(~_held_out()).select("doc_id", "text", "lang"), per_language)
    return KernelClassifier(texts, langs) if texts else None


def predict_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    held_out: crc32 of doc_id as text leaves 2 when divided by 4; such rows are
    not learned from, nor are rows with a null text or lang. lang_pred is a
    learned language, or ``und`` (score 0) where the text is null or has no
    letter, or where there was nothing to learn from. A null doc_id is held
    out. Repeated rows each get a row; other columns are ignored.
    """
    held = _held_out()
    model = _fitted(docs, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    return rows.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose language is found with at least that score; all columns kept.

    Each row is decided by its own text, whatever its doc_id.
    """
    return docs.mapInArrow(_identified(_fitted(docs), docs.columns.index("text"), least), docs.schema)
